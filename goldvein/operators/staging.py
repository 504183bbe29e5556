"""Column canonicalisation and the staging layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..plans import entities

KEYS = {"Customers": "customer_id", "Vendors": "vendor_id", "Products": "sku", "Invoices": "invoice_no", "Employees": "employee_id"}


def canonical_columns(df: DataFrame) -> DataFrame:
    """Known spellings to canonical names, the rest to lower case. Where two columns meet in one name, the one that
    already has it wins, else the first."""
    chosen: dict[str, str] = {}
    for c in df.columns:
        name = entities.ALIAS_OF.get(c.lower().strip(), c.lower())
        if name not in chosen or c == name:
            chosen[name] = c
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in chosen.items()])


def build(df: DataFrame, landing: str, staged_at=None) -> tuple[DataFrame | None, str]:
    """(staging frame, reason): the entity's columns with source system, time and validation; None and why if skipped."""
    entity = entities.entity_for_landing(landing)
    if entity is None:
        return None, "no entity matches the name"
    system = "_landing_source_system" in df.columns
    data = canonical_columns(df.select(*[c for c in df.columns if not c.startswith("_landing_")], *(["_landing_source_system"] if system else [])))
    keep = [c for c in entities.STAGING[entity] if c in data.columns]
    if not keep:
        return None, "no column of the entity"
    key = KEYS[entity]
    state = F.when(fx.is_blank(F.col(key).cast("string")), "rejected_null_pk").otherwise("ok") if key in keep else F.lit("rejected_no_pk_column")
    return data.select(
        *keep,
        (F.col("_landing_source_system") if system else F.lit(landing)).alias("_source_system"),
        (staged_at if staged_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("_staged_at"),
        state.alias("_validation"),
    ), "ok"


def table_name(landing: str) -> str:
    return f"stg_{entities.entity_for_landing(landing).lower()}__{landing.removeprefix('landing_')}"


def build_all(landings: dict[str, DataFrame], root: str | None = None) -> dict[str, DataFrame]:
    """Staging frames by name; written under ``root`` if given."""
    out = {}
    for name, df in landings.items():
        staged, _ = build(df, name)
        if staged is not None:
            out[table_name(name)] = staged
            if root:
                staged.write.mode("overwrite").parquet(f"{root}/{table_name(name)}")
    return out


def summary(staged: dict[str, DataFrame]) -> DataFrame:
    """table, rows, ok_rows of each staging frame, in one pass each."""
    frames = [df.agg(F.count("*").alias("rows"), F.count_if(F.col("_validation") == "ok").alias("ok_rows")).select(F.lit(n).alias("table"), "rows", "ok_rows") for n, df in sorted(staged.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def map_to_master(df: DataFrame, entity: entities.Entity, suggest=None, least: float = 0.7) -> DataFrame:
    """Per canonical field the first alias present, without regard to case. Columns left over go to ``suggest``
    (column name -> (field, confidence)); a field still free takes it from ``least`` confidence on."""
    have = {c.lower(): c for c in df.columns}
    chosen = {f: next((have[a] for a in aliases if a in have), None) for f, aliases in entity.fields.items()}
    if suggest:
        for c in df.columns:
            if c not in chosen.values() and not c.startswith("_"):
                f, confidence = suggest(c) or (None, 0)
                if f in chosen and chosen[f] is None and confidence >= least:
                    chosen[f] = c
    extra = [c for c in df.columns if c.startswith("_")]
    return df.select(*extra, *[F.col(f"`{c}`").cast("string").alias(f) for f, c in chosen.items() if c])


def rename_statuses(df: DataFrame, entity: str) -> DataFrame:
    words = entities.STATUS_RENAMES.get(entity)
    return df.replace(words, subset=["status"]) if words and "status" in df.columns else df
