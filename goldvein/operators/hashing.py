"""Content identity of files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_texts(df: DataFrame) -> DataFrame:
    """(line): cells as trimmed lower-case text, columns in name order, joined by commas; null is blank."""
    cells = [F.coalesce(F.lower(F.trim(F.col(f"`{c}`").cast("string"))), F.lit("")) for c in sorted(df.columns)]
    return df.select(F.concat_ws(",", *cells).alias("line"))


def content_hash(df: DataFrame) -> DataFrame:
    """(content_hash): SHA-256 over header and sorted rows; the same in any row or column order and file format.

    The exact digest needs all rows in one value; ``content_fingerprint`` is the form for large tables."""
    head = ",".join(sorted(df.columns))
    body = row_texts(df).agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("b"), F.count("*").alias("n"))
    return body.select(F.when(F.col("n") > 0, F.sha2(F.concat(F.lit(head + "\n"), "b"), 256)).alias("content_hash"))


def content_fingerprint(df: DataFrame) -> DataFrame:
    """rows, xor and sum of two 64-bit hashes per row: order-free and mergeable, for tables of any size."""
    h = row_texts(df).select(F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit(1)).alias("b"))
    return h.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor("a"), F.lit(0)).alias("hash_xor"), F.coalesce(F.sum(F.col("b").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"))


def duplicate_groups(files: DataFrame, by: str = "content_hash") -> DataFrame:
    """hash, n, canonical (the one seen first), paths of hashes that come more than once."""
    g = files.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("hash")).agg(F.count("*").alias("n"), F.min_by("file_path", F.struct("first_seen_at", "file_path")).alias("canonical"), F.array_join(F.sort_array(F.collect_list("file_path")), ",").alias("paths"))
    return g.filter("n > 1")


def upsert(files: DataFrame, new: DataFrame) -> DataFrame:
    """The hash table with ``new`` rows: first_seen_at stays, the rest is replaced; rows whose mtime is unchanged stay as they are."""
    old = files.select("file_path", F.col("mtime").alias("_m"), F.col("first_seen_at").alias("_f"))
    fresh = new.join(old, "file_path", "left").filter("_m is null or _m <> mtime").withColumn("first_seen_at", F.coalesce("_f", "first_seen_at")).drop("_m", "_f")
    return files.join(fresh.select("file_path"), "file_path", "left_anti").unionByName(fresh)


def duplicates_of(files: DataFrame) -> DataFrame:
    """(file_path, duplicate_path) of files with the same content, soft-deleted ones left out."""
    f = files.filter(~F.coalesce(F.col("soft_deleted"), F.lit(False)) & F.col("content_hash").isNotNull())
    a, b = f.select("file_path", "content_hash"), f.select(F.col("file_path").alias("duplicate_path"), "content_hash")
    return a.join(b, "content_hash").filter("file_path <> duplicate_path").select("file_path", "duplicate_path")


def gate(new: DataFrame, files: DataFrame, exempt: tuple[str, ...] = ("api_", "db_")) -> DataFrame:
    """``new`` files with duplicate_of: the oldest known file of the same content; exempt prefixes always pass."""
    known = files.filter(~F.coalesce(F.col("soft_deleted"), F.lit(False)))
    first = known.groupBy("content_hash").agg(F.min_by("file_path", F.struct("first_seen_at", "file_path")).alias("_first"))
    free = F.lit(False)
    for p in exempt:
        free = free | F.col("file_name").startswith(p)
    return new.join(first, "content_hash", "left").withColumn("duplicate_of", F.when(~free & (F.col("_first") != F.col("file_path")), F.col("_first"))).drop("_first")


def soft_delete(files: DataFrame, paths: DataFrame) -> DataFrame:
    gone = paths.select("file_path").distinct().withColumn("_gone", F.lit(True))
    return files.join(gone, "file_path", "left").withColumn("soft_deleted", F.coalesce("_gone", "soft_deleted")).drop("_gone")


def scan_summary(files: DataFrame) -> DataFrame:
    """files, bytes, distinct hashes, duplicate files of a listing."""
    g = files.groupBy("file_hash").agg(F.count("*").alias("n"), F.sum("length").alias("b"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), F.count("*").alias("distinct_files"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_files"))
