"""Duplicates across files: id columns, shared values, clusters, and what to keep."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from . import profile

# Fixed values.
ID_TOKENS = frozenset(["id", "no", "number", "num", "code", "ref", "reference", "key", "sku", "uuid", "guid", "invoice", "bill", "receipt", "account", "acct", "order", "transaction", "txn", "contract", "passport", "license", "licence", "plate", "vin", "imei", "emirates_id", "national_id", "tax_id", "vat"])
ID_PARTS = ["invoice", "bill", "receipt", "passport", "plate", "sku", "vin"]
NOT_IDS = ["_at", "_time", "_date", "_on", "name", "title", "description", "notes", "address", "city", "country", "region", "amount", "total", "price", "cost", "balance", "status", "type", "category", "valid", "verified", "opt_out", "active", "enabled"]
ID_ENDS = ("_id", "_no", "_code", "_ref", "_key", "_number")
KEY_HINTS = ["_no", "_number", "_ref", "invoice", "bill", "order", "receipt", "transaction", "txn"]
LINK_HINTS = ["customer", "client", "vendor", "supplier", "product", "user", "account"]
DISTINCT_SHARE, FORMAT_SHARE, LEAST_OVERLAP, SURE_OVERLAP = 0.95, 0.7, 0.10, 0.30


def named_like_id(column: str) -> bool:
    low = column.lower()
    return any(t in ID_TOKENS for t in re.split(r"[_\-\s]+", low)) or any(p in low for p in ID_PARTS)


def ruled_out(column: str) -> bool:
    low = column.lower()
    return any(d in low for d in NOT_IDS) and not low.endswith(ID_ENDS)


def id_columns(df: DataFrame, order: str | None = None) -> DataFrame:
    """column, by_name, by_distinct, by_format, signals, confidence of identifier-like columns; stats come from one
    shuffle and the first 50 values of each column."""
    columns = [c for c in df.columns if c != order and not ruled_out(c)]
    stats = profile.column_stats(df, columns).withColumn("filled", F.col("rows") - F.col("nulls"))
    parts = []
    for c in columns:
        v = df.filter(F.col(f"`{c}`").isNotNull())
        v = (v.orderBy(order) if order else v).limit(50).select(F.col(f"`{c}`").cast("string").alias("v"))
        parts.append(v.agg(F.count("*").alias("seen"), F.count_if(fx.looks_like_id(F.col("v"))).alias("like")).select(F.lit(c).alias("column"), "seen", "like"))
    firsts = parts[0]
    for p in parts[1:]:
        firsts = firsts.unionByName(p)
    names = F.col("column").isin([c for c in columns if named_like_id(c)]) if any(map(named_like_id, columns)) else F.lit(False)
    got = stats.join(firsts, "column").withColumns({
        "by_name": names,
        "by_distinct": (F.col("filled") >= F.greatest(F.lit(2), F.col("rows") / 2)) & (F.col("distinct_values") >= DISTINCT_SHARE * F.col("filled")),
        "by_format": (F.col("filled") >= 5) & (F.col("like") >= FORMAT_SHARE * F.col("seen")),
        "short": (F.col("rows") < 5) & (F.col("like") > 0),
    })
    n = sum(F.col(c).cast("int") for c in ("by_name", "by_distinct", "by_format"))
    fit = F.col("by_format") | (F.col("by_name") & (F.col("by_distinct") | F.col("short")))
    return got.filter(fit).select("column", "by_name", "by_distinct", "by_format", n.alias("signals"), F.when((F.col("by_format") & (n >= 2)) | (n == 3), "high").otherwise("medium").alias("confidence"))


def values(datasets: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """(dataset, column, value): distinct, trimmed, lower-case, not blank."""
    out = None
    for d, df in datasets.items():
        if columns.get(d):
            v = profile.long_values(df, columns[d]).select(F.lit(d).alias("dataset"), "column", F.lower(F.trim("value")).alias("value")).filter("value <> ''").distinct()
            out = v if out is None else out.unionByName(v)
    return out


def overlaps(datasets: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """(dataset_a, column_a, dataset_b, column_b, common, overlap) of columns in different datasets that share values:
    a self join on the value, the overlap is of the smaller set."""
    v = values(datasets, columns)
    sizes = v.groupBy("dataset", "column").agg(F.count("*").alias("size"))
    a, b = (v.select(F.col("dataset").alias(f"dataset_{s}"), F.col("column").alias(f"column_{s}"), "value") for s in "ab")
    common = a.join(b, "value").filter("dataset_a < dataset_b").groupBy("dataset_a", "column_a", "dataset_b", "column_b").agg(F.count("*").alias("common"))
    for s in "ab":
        common = common.join(sizes.select(F.col("dataset").alias(f"dataset_{s}"), F.col("column").alias(f"column_{s}"), F.col("size").alias(f"size_{s}")), [f"dataset_{s}", f"column_{s}"])
    return common.select("dataset_a", "column_a", "dataset_b", "column_b", "common", (F.col("common") / F.least("size_a", "size_b")).alias("overlap"))


def shared_columns(datasets: dict[str, DataFrame], found: dict[str, list[str]]) -> list[list[tuple[str, str]]]:
    """Columns that hold the same ids: equal names in two datasets or more win outright, else by value overlap."""
    by_name: dict[str, list] = {}
    for d, cs in found.items():
        for c in cs:
            by_name.setdefault(c.lower(), []).append((d, c))
    same = [m for m in by_name.values() if len({d for d, _ in m}) > 1]
    if same:
        return same
    pairs = sorted(overlaps(datasets, found).filter(F.col("overlap") >= LEAST_OVERLAP).collect(), key=lambda r: -r.overlap)
    used, out = set(), []
    for r in pairs:
        a, b = (r.dataset_a, r.column_a), (r.dataset_b, r.column_b)
        if a not in used and b not in used:
            used |= {a, b}
            out.append([a, b])
    return out


def clusters(datasets: dict[str, DataFrame], members: list[tuple[str, str]], index: str) -> DataFrame:
    """One row per member row of an id value found in two datasets or more: id_value, dataset, row, completeness,
    keep. The fullest row is kept; ties go to the first dataset, then the first row."""
    out = None
    for place, (d, c) in enumerate(members):
        df = datasets[d]
        data = [x for x in df.columns if x != index]
        filled = sum(F.when(fx.is_blank(F.col(f"`{x}`").cast("string")), 0).otherwise(1) for x in data)
        rows = df.select(F.lower(F.trim(F.col(f"`{c}`").cast("string"))).alias("id_value"), F.lit(d).alias("dataset"), F.lit(place).alias("_place"), F.col(index).alias("row"), (filled / len(data)).alias("completeness"))
        out = rows if out is None else out.unionByName(rows)
    out = out.filter("id_value <> ''")
    good = out.groupBy("id_value").agg(F.min("_place").alias("_l"), F.max("_place").alias("_h"), F.max(F.struct("completeness", -F.col("_place"), -F.col("row"))).alias("_best")).filter("_l <> _h")
    best = (F.col("_best.completeness") == F.col("completeness")) & (F.col("_best")["col2"] == -F.col("_place")) & (F.col("_best")["col3"] == -F.col("row"))
    return out.join(good, "id_value").select("id_value", "dataset", "row", "completeness", best.alias("keep"))


def column_groups(datasets: dict[str, DataFrame], columns: dict[str, list[str]], least: float = LEAST_OVERLAP) -> list[dict]:
    """Groups of columns linked by overlap (union of links over columns, which are few), with the best overlap."""
    rows = overlaps(datasets, columns).filter(F.col("overlap") >= least).collect()
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in rows:
        a, b = find((r.dataset_a, r.column_a)), find((r.dataset_b, r.column_b))
        root[max(a, b)] = min(a, b)
    groups: dict = {}
    for x in list(root):
        groups.setdefault(find(x), {"members": [], "overlap": 0.0})["members"].append(x)
    for r in rows:
        g = groups[find((r.dataset_a, r.column_a))]
        g["overlap"] = max(g["overlap"], r.overlap)
    out = [{"members": sorted(g["members"]), "overlap": g["overlap"], "auto": g["overlap"] >= SURE_OVERLAP} for g in groups.values()]
    return sorted(out, key=lambda g: -g["overlap"])


def link_class(column, overlap):
    """primary_key_match, foreign_key_link or uncertain, as a column expression over a name and a share."""
    low = F.lower(column)
    key = low.rlike("|".join(KEY_HINTS)) & (overlap >= 0.05) & (overlap <= 0.60)
    link = low.rlike("|".join(LINK_HINTS)) & low.endswith("id") & (overlap > 0.60)
    return F.when(key, "primary_key_match").when(link | (overlap > 0.90), "foreign_key_link").otherwise("uncertain")


def classify_groups(spark: SparkSession, groups: list[dict]) -> DataFrame:
    rows = [(i, g["members"][0][1], g["overlap"]) for i, g in enumerate(groups)]
    got = spark.createDataFrame(rows, "group_no int, column string, overlap double")
    out = got.withColumn("classification", link_class(F.col("column"), F.col("overlap")))
    return out.withColumn("dedup_recommended", F.col("classification") == "primary_key_match")


def archive(df: DataFrame, plan: DataFrame, index: str, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(remaining rows renumbered from 0, archived rows as JSON): rows of ``plan`` (row, reason) leave; unknown ones are ignored."""
    out = df.join(plan.select(F.col("row").alias(index), "reason").dropDuplicates([index]), index)
    gone = out.select(F.lit(dataset).alias("dataset_id"), F.col(index).alias("original_row_index"), F.to_json(F.struct(*[c for c in df.columns if c != index])).alias("row_data_json"), "reason")
    left = df.join(plan.select(F.col("row").alias(index)), index, "left_anti")
    return left, gone


def renumber(df: DataFrame, index: str) -> DataFrame:
    from .normalize import numbered

    return numbered(df, index, "_new").withColumn(index, F.col("_new") - 1).drop("_new")


def exact_keep(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
