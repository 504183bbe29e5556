"""Cleansing and key expressions: all native, null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ACRONYMS = ["NY", "LA", "CA", "UK", "US", "USA", "UAE", "EU", "IT", "HR", "CEO", "CFO", "CTO", "COO", "VIP", "R&D"]
STATUS_CODES = {
    "ACT": "Active", "INA": "Inactive", "TRM": "Terminated", "LOA": "On Leave", "PND": "Pending",
    "PAID": "Paid", "UNPAID": "Unpaid", "OVD": "Overdue", "DUE": "Pending", "CNL": "Cancelled", "CANCELLED": "Cancelled",
    "A": "Active", "I": "Inactive", "P": "Paid", "U": "Unpaid", "Y": "Active", "N": "Inactive",
}
COUNTRY_TO_ISO = {
    "USA": "US", "UNITED STATES": "US", "UNITED STATES OF AMERICA": "US", "US": "US", "UK": "GB", "UNITED KINGDOM": "GB", "GREAT BRITAIN": "GB", "ENGLAND": "GB",
    "UAE": "AE", "UNITED ARAB EMIRATES": "AE", "EMIRATES": "AE", "SAUDI ARABIA": "SA", "SAUDI": "SA", "KSA": "SA", "FRANCE": "FR", "GERMANY": "DE", "ITALY": "IT", "SPAIN": "ES",
    "NETHERLANDS": "NL", "BELGIUM": "BE", "SWEDEN": "SE", "NORWAY": "NO", "DENMARK": "DK", "FINLAND": "FI", "POLAND": "PL", "PORTUGAL": "PT", "AUSTRIA": "AT", "SWITZERLAND": "CH", "IRELAND": "IE",
    "CANADA": "CA", "MEXICO": "MX", "BRAZIL": "BR", "ARGENTINA": "AR", "AUSTRALIA": "AU", "NEW ZEALAND": "NZ", "CHINA": "CN", "JAPAN": "JP", "SOUTH KOREA": "KR", "KOREA": "KR",
    "INDIA": "IN", "PAKISTAN": "PK", "BANGLADESH": "BD", "SINGAPORE": "SG", "PHILIPPINES": "PH", "INDONESIA": "ID", "THAILAND": "TH", "VIETNAM": "VN", "MALAYSIA": "MY", "HONG KONG": "HK", "TAIWAN": "TW",
    "EGYPT": "EG", "JORDAN": "JO", "LEBANON": "LB", "TURKEY": "TR", "ISRAEL": "IL", "QATAR": "QA", "KUWAIT": "KW", "BAHRAIN": "BH", "OMAN": "OM",
    "SOUTH AFRICA": "ZA", "NIGERIA": "NG", "KENYA": "KE", "MOROCCO": "MA", "RUSSIA": "RU", "UKRAINE": "UA",
}

THOUSANDS = r"^\s*-?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?\s*$"
EMAIL_SYNTAX = r"^[a-z0-9._%+'-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}$"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
DATE_FORMATS = [
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "yyyy-M-d"), (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"), (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "M-d-yyyy"), (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"),
    (r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$", "d-MMM-yyyy"), (r"^[0-9]{8}$", "yyyyMMdd"),
]


def lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def squeeze(c: Column) -> Column:
    """Outer white space off, inner runs to one space."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " ")


def strip_thousands(c: Column) -> Column:
    return F.when(c.rlike(THOUSANDS), F.regexp_replace(c, ",", "")).otherwise(c)


def capitalize_words(c: Column) -> Column:
    """Each white-space word: first letter upper, the rest lower."""
    return F.array_join(F.transform(F.split(squeeze(c), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 100_000)))), " ")


def clean_name(c: Column) -> Column:
    """Names in one case get capitals per word, acronyms stay upper; mixed case is only trimmed; blank stays."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    word = lambda w: F.when(F.upper(w).isin(ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 100_000))))
    cased = (F.upper(t) != F.lower(t)) & ((t == F.upper(t)) | (t == F.lower(t)))
    return F.when(t == "", c).when(cased, F.array_join(F.transform(F.split(squeeze(t), " "), word), " ")).otherwise(t)


def clean_status(c: Column) -> Column:
    """Codes to labels, capitals per word; blank to Unknown."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(t == "", "Unknown").when(c.isNotNull(), capitalize_words(F.coalesce(lookup(STATUS_CODES, F.upper(t)), t)))


def clean_email(c: Column) -> Column:
    t = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(email_ok(c), t).otherwise(c)


def email_ok(c: Column) -> Column:
    t = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return t.rlike(EMAIL_SYNTAX) & ~t.contains("..")


def parse_date(c: Column) -> Column:
    """The first format of the ordered list that fits (month before day); null if none does."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    tries = []
    for shape, fmt in DATE_FORMATS:
        text = F.regexp_extract(t, r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})", 1) if fmt == "yyyy-M-d" else t
        tries.append(F.when(t.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)).cast("date")))
    return F.coalesce(*tries)


def clean_date(c: Column) -> Column:
    return F.coalesce(F.date_format(parse_date(c), "yyyy-MM-dd"), c)


def normalize_key(c: Column) -> Column:
    """Identifier in one spelling: upper, separator runs to one hyphen, none at the ends; null and blank give ''."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.upper(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s\-_/.]+", "-"), "^-+|-+$", ""), F.lit(""))


def clean_currency(c: Column) -> Column:
    out = F.regexp_replace(c, r"[^0-9.\-]", "")
    return F.when(out != "", out)


def number(c: Column) -> Column:
    """A text as a double where it is a plain number, else null (in every engine alike)."""
    t = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def looks_like_id(c: Column) -> Column:
    """A structured code: at most 50 characters, alphanumeric between separators, with a digit, and a letter or 4 to 20 long."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    bare = F.regexp_replace(t, r"[\s\-_/.:]", "")
    return F.coalesce(
        (t != "") & (F.length(t) <= 50) & (F.length(bare) >= 3) & bare.rlike("^[A-Za-z0-9]+$") & bare.rlike("[0-9]") & (bare.rlike("[A-Za-z]") | F.length(bare).between(4, 20)),
        F.lit(False),
    )


def iso_country(c: Column) -> Column:
    return F.coalesce(lookup(COUNTRY_TO_ISO, F.upper(F.trim(c))), c)
