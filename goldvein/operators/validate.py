"""Validation against curated, learned and promoted schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..plans import entities

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
LEARNED_AT = 100
# Id patterns in order.
ID_PATTERNS = [r"^[A-Z]+-[0-9]+$", r"^[A-Z]+-[0-9]+-[0-9]+$", r"^[A-Z]+-[A-Z0-9-]+$", r"^[0-9]+$", r"^[A-Z0-9]+$"]


def digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]", ""))


def passes(check: entities.Check, blank_as_null: bool = False) -> Column:
    """Whether a row meets a check. Nulls always do; blanks only if ``blank_as_null``."""
    c = F.col(f"`{check.column}`").cast("string")
    ok = {
        "regex": lambda: c.rlike(check.value),
        "number": lambda: F.coalesce(fx.number(c) >= 0, F.lit(False)),
        "integer": lambda: F.coalesce((fx.number(c) >= 0) & (fx.number(c) % 1 == 0), F.lit(False)),
        "email": lambda: c.rlike(EMAIL),
        "phone": lambda: digits(c).between(8, 15),
        "status": lambda: c.isin(list(check.value)),
        "nonblank": lambda: F.trim(c) != "",
        "blank": lambda: F.trim(c) == "",
    }[check.kind]()
    return c.isNull() | ok | (F.trim(c) == "" if blank_as_null and check.kind != "nonblank" else F.lit(False))


SAYS = {"regex": "has another format", "number": "must be a number of at least 0", "integer": "must be a whole number of at least 0", "email": "must be an e-mail address", "phone": "must have 8 to 15 digits", "status": "is not in the vocabulary", "nonblank": "must not be empty", "blank": "must be empty"}


def with_reason(df: DataFrame, checks: list[entities.Check], blank_as_null: bool = False) -> DataFrame:
    """``df`` with ``_rejection_reason``: the failed checks' messages, '' if none. Missing columns fail no row."""
    rules = [F.when(~passes(c, blank_as_null), F.lit(f"{c.column}: {SAYS[c.kind]}")) for c in checks if c.column in df.columns]
    return df.withColumn("_rejection_reason", F.concat_ws("; ", *rules) if rules else F.lit(""))


def split(df: DataFrame, checks: list[entities.Check], blank_as_null: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reasons)."""
    judged = with_reason(df, checks, blank_as_null)
    return judged.filter("_rejection_reason = ''").drop("_rejection_reason"), judged.filter("_rejection_reason <> ''")


def missing_required(df: DataFrame, entity: str) -> list[str]:
    return [c for c in entities.REQUIRED.get(entity, [entities.MASTERS[entity][1]]) if c not in df.columns]


def learn(df: DataFrame, sample: int = 50) -> dict[str, dict]:
    """Column metadata of a batch from one aggregate: type, nullable, and checks that its values meet."""
    aggs = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        s = c.cast("string")
        aggs += [F.count_if(c.isNull()).alias(f"null{i}"), F.count(c).alias(f"n{i}")]
        if f.dataType.simpleString() in ("int", "bigint", "smallint", "tinyint", "float", "double"):
            aggs.append(F.coalesce(F.min(c) >= 0, F.lit(True)).alias(f"pos{i}"))
        else:
            aggs += [F.coalesce(F.bool_and(s.rlike(p)), F.lit(False)).alias(f"p{i}_{k}") for k, p in enumerate(ID_PATTERNS)]
            # at most 21 distinct values are kept: enough to tell an enumeration from free text
            aggs += [F.approx_count_distinct(s).alias(f"d{i}")]
    row = df.agg(*aggs).first()
    out = {}
    for i, f in enumerate(df.schema.fields):
        low, kind, checks = f.name.lower(), f.dataType.simpleString(), []
        number = f"pos{i}" in row
        meta = {"dtype": "float" if kind in ("float", "double") else "int" if number else "str", "nullable": row[f"null{i}"] > 0, "checks": checks}
        if number and row[f"pos{i}"]:
            checks.append({"type": "ge", "value": 0})
        if row[f"n{i}"] and not number:
            if "email" in low:
                checks.append({"type": "email"})
            elif any(w in low for w in ("phone", "mobile", "tel")):
                checks.append({"type": "phone"})
            elif "status" in low or low.endswith("_state"):
                if row[f"d{i}"] <= 40:
                    seen = sorted(r[0] for r in df.select(F.col(f"`{f.name}`").cast("string")).filter(F.col(f"`{f.name}`").isNotNull()).distinct().limit(21).collect())
                    if 1 < len(seen) <= 20:
                        checks.append({"type": "isin", "values": seen})
            elif low.endswith(("_id", "_code", "_no")):
                if hit := next((p for k, p in enumerate(ID_PATTERNS) if row[f"p{i}_{k}"]), None):
                    checks.append({"type": "regex", "value": hit})
                if not meta["nullable"]:
                    checks.append({"type": "non_empty"})
        out[f.name] = meta
    return out


def learned_frame(df: DataFrame) -> DataFrame:
    """column, dtype, nullable, checks (type, or type=value, joined by ;) of a batch's learned metadata."""
    say = lambda c: c["type"] if "value" not in c and "values" not in c else f"{c['type']}={'|'.join(c['values']) if 'values' in c else c['value']}"
    rows = [(n, m["dtype"], m["nullable"], ";".join(map(say, m["checks"]))) for n, m in learn(df).items()]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, nullable boolean, checks string")


def merge_metadata(old: dict, new: dict) -> dict:
    """Nullable if either was; vocabularies are united; other checks stay as first learned; new columns are added."""
    out = json.loads(json.dumps(old))
    for name, meta in new.items():
        if name not in out:
            out[name] = meta
            continue
        out[name]["nullable"] = out[name]["nullable"] or meta["nullable"]
        for c in out[name]["checks"]:
            if c["type"] == "isin":
                more = next((x["values"] for x in meta["checks"] if x["type"] == "isin"), [])
                c["values"] = sorted({*c["values"], *more})
    return out


def learned_checks(meta: dict) -> list[entities.Check]:
    kinds = {"ge": "number", "email": "email", "phone": "phone", "non_empty": "nonblank"}
    return [entities.Check(n, "status" if c["type"] == "isin" else "regex" if c["type"] == "regex" else kinds[c["type"]], tuple(c["values"]) if c["type"] == "isin" else c.get("value")) for n, m in meta.items() for c in m["checks"]]


class DynamicSchemas:
    """Learned schemas by entity: learning until ``threshold`` rows, then established; promotion freezes them. With a
    catalogue they are kept there, and known again to the next process."""

    def __init__(self, threshold: int = LEARNED_AT, catalog=None):
        self.threshold, self.catalog, self.rows = threshold, catalog, {}
        for r in catalog.rows("dynamic_schemas") if catalog else []:
            self.rows[r["entity"]] = {"schema": json.loads(r["schema_json"]), "status": r["status"], "row_count_observed": r["row_count_observed"]}

    def _keep(self, entity: str) -> None:
        if self.catalog:
            r = self.rows[entity]
            self.catalog.append("dynamic_schemas", {"entity": entity, "status": r["status"], "row_count_observed": r["row_count_observed"], "schema_json": json.dumps(r["schema"], sort_keys=True)})

    def observe(self, entity: str, df: DataFrame) -> dict:
        n, old = df.count(), self.rows.get(entity)
        if old and old["status"] == "curated":
            return old
        meta = learn(df)
        if old is None:
            self.rows[entity] = {"schema": meta, "status": "learning", "row_count_observed": n}
        else:
            seen = old["row_count_observed"] + n
            self.rows[entity] = {"schema": merge_metadata(old["schema"], meta), "status": "established" if seen >= self.threshold else "learning", "row_count_observed": seen}
        self._keep(entity)
        return self.rows[entity]

    def promote(self, entity: str) -> bool:
        if entity not in self.rows:
            return False
        self.rows[entity]["status"] = "curated"
        self._keep(entity)
        return True

    def frame(self, spark) -> DataFrame:
        rows = [(e, r["status"], r["row_count_observed"], self.threshold, json.dumps(r["schema"], sort_keys=True)) for e, r in sorted(self.rows.items())]
        return spark.createDataFrame(rows, "entity string, status string, row_count_observed long, threshold int, schema_json string")

    def validate(self, df: DataFrame, entity: str, blank_as_null: bool = False) -> tuple[DataFrame, DataFrame, str]:
        """(valid, rejected, state): curated entities are held to their checks; unknown ones are learned first."""
        if entity in entities.SCHEMAS:
            return *split(df, entities.SCHEMAS[entity], blank_as_null), "curated"
        known = self.rows.get(entity)
        if known and known["status"] != "learning":
            good, bad = split(df, learned_checks(known["schema"]), blank_as_null)
            self.observe(entity, good)
            return good, bad, known["status"]
        state = self.observe(entity, df)["status"]
        return df, df.limit(0).withColumn("_rejection_reason", F.lit("")), state
