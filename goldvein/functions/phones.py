"""Phone numbers to E.164 by a table of number plans: prefix, national lengths, trunk digit. Validity beyond length is
not judged. Regions are tried in table order, the row's own country first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: region -> (country code, trunk digit or '', shortest and longest national number)
PLANS = {
    "AE": ("971", "0", 8, 9), "SA": ("966", "0", 8, 9), "US": ("1", "", 10, 10), "GB": ("44", "0", 9, 10),
    "DE": ("49", "0", 7, 11), "FR": ("33", "0", 9, 9), "JP": ("81", "0", 9, 10), "ES": ("34", "", 9, 9),
}
#: Spellings of the regions in a country column.
REGION_NAMES = {
    "uae": "AE", "united arab emirates": "AE", "ae": "AE", "saudi arabia": "SA", "saudi": "SA", "ksa": "SA", "sa": "SA", "usa": "US", "united states": "US", "us": "US",
    "uk": "GB", "united kingdom": "GB", "gb": "GB", "germany": "DE", "de": "DE", "france": "FR", "fr": "FR", "japan": "JP", "jp": "JP", "spain": "ES", "es": "ES",
}


def national(digits: Column, region: str) -> Column:
    code, trunk, low, high = PLANS[region]
    own = F.when(digits.startswith(trunk), F.substring(digits, 2, 40)).otherwise(digits) if trunk else digits
    return F.when(F.length(own).between(low, high), F.concat(F.lit(f"+{code}"), own))


def e164(c: Column, country: Column | None = None) -> Column:
    """The number in E.164; null if no plan fits."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    digits = F.regexp_replace(t, "[^0-9]", "")
    abroad = t.startswith("+") | t.startswith("00")
    full = F.when(t.startswith("+"), digits).otherwise(F.substring(digits, 3, 40))
    tries = [national(digits, r) for r in PLANS]
    if country is not None:
        names = F.create_map(*[F.lit(x) for kv in REGION_NAMES.items() for x in kv])
        region = F.element_at(names, F.lower(F.trim(country)))
        tries = [F.when(region == r, national(digits, r)) for r in PLANS] + tries
    return F.when(abroad, F.when(F.length(full).between(8, 15), F.concat(F.lit("+"), full))).otherwise(F.coalesce(*tries))


def clean_phone(c: Column, country: Column | None = None) -> Column:
    """E.164, or the value as it is where no plan fits."""
    return F.coalesce(e164(c, country), c)
