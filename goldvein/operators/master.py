"""Golden records: set-based ingest of one source into a master table, with lineage and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..plans import entities
from . import staging, validate


def target_keys(incoming: DataFrame, master: DataFrame, key: str, within_batch: bool = False) -> DataFrame:
    """``incoming`` with target_pk and how it was found: exact, normalized, or new.

    The exact probe and the probe by normalized key are two equi-joins; the second gets only what the first left. One
    master key per normalized key: the greatest. With ``within_batch`` new keys of equal normal form share a target."""
    known = master.select(F.col(key).alias("_m")).distinct()
    probe = incoming.withColumn("_k", F.trim(F.col(key).cast("string")))
    hit = probe.join(known, probe._k == known._m, "left")
    exact = hit.filter("_m is not null").withColumns({"target_pk": F.col("_m"), "found": F.lit("exact")}).drop("_m")
    rest = hit.filter("_m is null").drop("_m").withColumn("_n", fx.normalize_key(F.col("_k")))
    near = known.select("_m", fx.normalize_key(F.col("_m")).alias("_n")).filter("_n <> ''").groupBy("_n").agg(F.max("_m").alias("_m"))
    both = rest.join(near, "_n", "left")
    own = F.col("_k")
    if within_batch:
        firsts = both.filter("_m is null and _n <> ''").groupBy("_n").agg(F.min("_k").alias("_own"))
        both = both.join(firsts, "_n", "left")
        own = F.coalesce("_own", "_k")
    both = both.withColumns({"target_pk": F.coalesce("_m", own), "found": F.when(F.col("_m").isNotNull(), "normalized").otherwise("new")})
    names = [*incoming.columns, "target_pk", "found"]
    return exact.select(*names).unionByName(both.select(*names))


def first_filled(c: str, order: Column) -> Column:
    """The first value that isn't blank, else the first value."""
    filled = F.min_by(F.col(c), F.when(~fx.is_blank(F.col(c)), order))
    any_filled = F.bool_or(~fx.is_blank(F.col(c)))
    return F.when(any_filled, filled).otherwise(F.min_by(F.col(c), order))


@dataclass
class Ingested:
    master: DataFrame
    rejected: DataFrame
    sources: DataFrame
    summary: DataFrame
    missing_required: list[str]


def merged(keyed: DataFrame, master: DataFrame, key: str, columns: list[str], index: str) -> DataFrame:
    """One row per key: (key, columns, n_incoming, inserted, fields_enriched, donors).

    Master rows come first, then the batch in row order; a filled value is never replaced, so the first filled value
    of each column is what filling one after the other would give."""
    have = [c for c in columns if c in keyed.columns]
    pad = lambda df, cols: [F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in cols]
    data = [c for c in columns if c != key]
    rows = master.select(F.col(key).alias("target_pk"), *pad(master, data), F.lit(0).alias("_side"), F.lit(-1).cast("long").alias("_row")).unionByName(
        keyed.select("target_pk", *pad(keyed.select(*[c for c in have if c != key], "target_pk"), data), F.lit(1).alias("_side"), F.col(index).cast("long").alias("_row"))
    )
    order = F.struct("_side", "_row")
    aggs = []
    for c in data:
        filled = ~fx.is_blank(F.col(c))
        aggs += [first_filled(c, order).alias(c), fx.is_blank(F.min_by(F.col(c), order)).alias(f"_b_{c}"), F.min(F.when(filled, order)).alias(f"_d_{c}")]
    g = rows.groupBy("target_pk").agg(*aggs, F.sum("_side").alias("n_incoming"), (F.min("_side") == 1).alias("inserted"))
    enriched = [F.when(F.col(f"_b_{c}") & F.col(f"_d_{c}").isNotNull(), F.col(f"_d_{c}")["_row"]) for c in data]
    donors = F.array_distinct(F.filter(F.array(*enriched), lambda x: x.isNotNull()))
    n = sum(F.when(e.isNotNull(), 1).otherwise(0) for e in enriched)
    return g.select(F.col("target_pk").alias(key), *data, "n_incoming", "inserted", n.alias("fields_enriched"), F.size(donors).alias("rows_enriched"))


def ingest(
    batch: DataFrame, entity: entities.Entity, dataset_id: str, source_system: str, index: str, master: DataFrame | None = None, sources: DataFrame | None = None,
    blank_as_null: bool = False, within_batch: bool = False, checks=None, now: Column | None = None, suggest=None,
) -> Ingested:
    """Map, rename statuses, validate, match, merge or insert. ``batch`` needs the row index column ``index``.

    Returns the new master (with audit columns), rejected rows with reasons, the grown lineage table, and the counts."""
    spark, key = batch.sparkSession, entity.key
    when = now if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    mapped = staging.map_to_master(batch.withColumnRenamed(index, "_row_idx"), entity, suggest)
    mapped = staging.rename_statuses(mapped, entity.name)
    if key not in mapped.columns:
        raise ValueError(f"no column for {key}")
    good, bad = validate.split(mapped, entity.checks if checks is None else checks, blank_as_null)
    keyless = good.filter(fx.is_blank(F.col(key)))
    good = good.filter(~fx.is_blank(F.col(key)))
    if master is None:
        master = spark.createDataFrame([], ", ".join([f"{c} string" for c in entity.columns] + [f"{c} {t}" for c, t in entities.AUDIT.items()]))
    if sources is None:
        sources = spark.createDataFrame([], "master_table string, pk_value string, dataset_id string, source_system string")
    keyed = target_keys(good, master, key, within_batch)
    new = merged(keyed, master, key, entity.columns, "_row_idx")
    touched = keyed.select(F.lit(entity.table).alias("master_table"), F.col("target_pk").alias("pk_value"), F.lit(dataset_id).alias("dataset_id"), F.lit(source_system).alias("source_system")).distinct()
    lineage = sources.select("master_table", "pk_value", "dataset_id", "source_system").unionByName(touched).distinct()
    systems = lineage.filter(F.col("master_table") == entity.table).groupBy(F.col("pk_value").alias(key)).agg(F.countDistinct("source_system").alias("_systems"))
    first = keyed.groupBy(F.col("target_pk").alias(key)).agg(F.min("_row_idx").alias("_first"))
    old = master.select(key, *[F.col(c).alias(f"_o_{c}") for c in entities.AUDIT])
    full = new.join(systems, key, "left").join(first, key, "left").join(old, key, "left")
    merged_any = F.col("n_incoming") > 0
    audit = {
        "source_dataset_id": F.coalesce("_o_source_dataset_id", F.lit(dataset_id)),
        "source_row_index": F.coalesce("_o_source_row_index", F.col("_first").cast("long")),
        "ingested_at": F.coalesce(F.col("_o_ingested_at"), when),
        "last_updated": F.when(merged_any, when).otherwise(F.col("_o_last_updated")),
        "merged_from_count": F.when(merged_any, F.greatest(F.lit(1), F.coalesce("_systems", F.lit(1)))).otherwise(F.col("_o_merged_from_count")).cast("long"),
        "confidence_score": F.coalesce("_o_confidence_score", F.lit(1.0)),
        "archived_at": F.col("_o_archived_at"),
    }
    out = full.select(key, *[c for c in entity.columns if c != key], *[c.alias(n) for n, c in audit.items()])
    counts = new.agg(
        F.count_if("inserted").alias("rows_inserted"),
        F.coalesce(F.sum(F.col("n_incoming") - F.col("inserted").cast("int")), F.lit(0)).cast("long").alias("rows_duplicates_found"),
        F.coalesce(F.sum("rows_enriched"), F.lit(0)).cast("long").alias("rows_enriched"),
        F.coalesce(F.sum("fields_enriched"), F.lit(0)).cast("long").alias("fields_enriched_total"),
    )
    n_rejected = keyless.agg(F.count("*").alias("rows_rejected")).crossJoin(bad.agg(F.count("*").alias("rows_rejected_by_schema")))  # one row each
    summary = counts.crossJoin(n_rejected).withColumn("total_processed", F.expr("rows_inserted + rows_duplicates_found + rows_rejected + rows_rejected_by_schema"))
    return Ingested(out, rejections(bad, entity.name, dataset_id, key), lineage, summary, validate.missing_required(mapped, entity.name))


def rejections(bad: DataFrame, entity: str, dataset_id: str, key: str) -> DataFrame:
    """Rejected rows as JSON with their reasons."""
    data = [c for c in bad.columns if not c.startswith("_")]
    pk = F.col(key).cast("string") if key in bad.columns else F.lit(None).cast("string")
    return bad.select(F.lit(entity).alias("entity"), F.lit(dataset_id).alias("dataset_id"), pk.alias("pk_value"), F.col("_rejection_reason").alias("rejection_reason"), F.to_json(F.struct(*data)).alias("row_data"))


def active(master: DataFrame) -> DataFrame:
    return master.filter(F.col("archived_at").isNull()) if "archived_at" in master.columns else master


def master_summary(masters: dict[str, tuple[DataFrame, str]], lineage: DataFrame) -> DataFrame:
    """entity, records, source_families (source system up to the first underscore), total_inputs, merged_records."""
    out = None
    for name, (df, table) in masters.items():
        a = active(df).agg(F.count("*").alias("records"), F.coalesce(F.sum("merged_from_count"), F.lit(0)).alias("total_inputs"), F.count_if(F.col("merged_from_count") > 1).alias("merged_records"))
        f = lineage.filter(F.col("master_table") == table).agg(F.countDistinct(F.substring_index("source_system", "_", 1)).alias("source_families"))
        row = a.crossJoin(f).select(F.lit(name).alias("entity"), "records", "source_families", "total_inputs", "merged_records")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def browse(master: DataFrame, order: list[Column], most: int = 50) -> DataFrame:
    return active(master).orderBy(*order).limit(most).drop(*[c for c in master.columns if c.startswith("_")])


def search(master: DataFrame, query: str, order: list[Column], most: int = 50, pool: int | None = None) -> DataFrame:
    """Rows with ``query`` in any value, newest first; ``pool`` looks at the newest rows only."""
    rows = active(master).orderBy(*order)
    rows = rows.limit(pool) if pool else rows
    hit = None
    for c in master.columns:
        if not c.startswith("_"):
            one = F.coalesce(F.lower(F.col(f"`{c}`").cast("string")).contains(query.lower()), F.lit(False))
            hit = one if hit is None else hit | one
    return rows.filter(hit).orderBy(*order).limit(most)


def record_sources(lineage: DataFrame, datasets: DataFrame, table: str, pk: str) -> DataFrame:
    one = lineage.filter((F.col("master_table") == table) & (F.col("pk_value") == pk))
    return one.join(datasets, "dataset_id", "left").orderBy("dataset_id")


def absorb(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` whose key it lacks, one a key; columns that either lacks are added empty."""
    fresh = new.filter(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) != "").dropDuplicates([key])
    if old is None:
        return fresh
    return old.unionByName(fresh.join(old.select(key), key, "left_anti"), allowMissingColumns=True)
