"""Functional dependencies, entity tables, and schema text."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import entities
from ..sources.store import Store
from . import master, profile

HOLDS, LEAST_ROWS, REPEATED = 0.98, 20, 0.5
# Fixed values.
STOP = frozenset(["id", "name", "number", "no", "code", "ref", "type", "status", "1", "2", "3", "first", "last", "the", "a", "an"])
MEANINGS = [
    (["customer", "phone"], "Customers"), (["contact", "phone"], "Customers"), (["contact", "address"], "Customers"), (["customer", "address"], "Customers"), (["product", "msrp"], "Products"), (["product", "price"], "Products"), (["product", "code"], "Products"),
    (["order", "date"], "Orders"), (["order", "status"], "Orders"), (["month", "qtr"], "Calendar"), (["month", "year"], "Calendar"), (["city", "country"], "Locations"), (["city", "state"], "Locations"), (["address", "postal"], "Addresses"),
    (["vendor", "phone"], "Vendors"), (["supplier", "phone"], "Suppliers"), (["employee", "department"], "Employees"), (["owner", "email"], "Owners"),
]
KINDS = [(["customer", "client"], "Customers"), (["vendor", "supplier"], "Vendors"), (["product", "sku", "msrp"], "Products"), (["order"], "Orders"), (["address", "postal", "zip"], "Addresses"), (["city", "country", "state", "region", "territory"], "Locations"), (["employee", "staff"], "Employees"), (["month", "year", "quarter", "qtr"], "Calendar")]
TEXT_NAMES = ("phone", "mobile", "fax", "zip", "postal", "code")


def fd_matrix(df: DataFrame) -> DataFrame:
    """(determinant, dependent, groups, holding): in how many groups of the determinant the dependent has one value.

    Per determinant one group-by with all dependents: a group holds if its least and greatest values agree and either
    all or none are null, so no distinct sets are built."""
    parts = []
    for a in df.columns:
        others = [b for b in df.columns if b != a]
        aggs = []
        for i, b in enumerate(others):
            c = F.col(f"`{b}`")
            aggs.append((F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == F.count("*")))).alias(f"h{i}"))
        per = df.groupBy(F.col(f"`{a}`").alias("_a")).agg(*aggs) if aggs else None
        if per is None:
            continue
        tally = per.agg(F.count("*").alias("groups"), *[F.count_if(f"h{i}").alias(f"k{i}") for i in range(len(others))])
        parts.append(tally.select("groups", F.inline(F.array(*[F.struct(F.lit(b).alias("dependent"), F.col(f"k{i}").alias("holding")) for i, b in enumerate(others)]))).select(F.lit(a).alias("determinant"), "dependent", "groups", "holding"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def plan_entities(df: DataFrame) -> list[dict]:
    """Entity groups: repeated low-cardinality anchors with what they determine, by falling reduction. Decided on the
    driver from one row per column and pair of columns."""
    rows = df.count()
    if rows < LEAST_ROWS or len(df.columns) < 2:
        return []
    share = {(r.determinant, r.dependent): r.holding / r.groups if r.groups else 0.0 for r in fd_matrix(df).collect()}
    distinct = {r["column"]: r["distinct_values"] + (r["nulls"] > 0) for r in profile.column_stats(df).collect()}
    anchors = sorted((c for c in df.columns if 2 <= distinct[c] < REPEATED * rows), key=distinct.get)
    used, out = set(), []
    for a in anchors:
        if a in used:
            continue
        group = [a, *[b for b in df.columns if b != a and b not in used and share[a, b] >= HOLDS]]
        if len(group) > 1:
            n = df.select(*[F.col(f"`{c}`") for c in group]).distinct().count()
            if n < REPEATED * rows:
                used.update(group)
                out.append({"columns": sorted(group), "distinct_rows": n, "reduction_ratio": round(1 - n / rows, 3)})
    out.sort(key=lambda g: -g["reduction_ratio"])
    for g in out:
        g["name"] = entity_name(g["columns"])
    return out


def plural(word: str) -> str:
    return word if word.endswith("s") else word[:-1] + "ies" if re.search("[^aeou]y$|^y$", word) else word + "s"


def entity_name(columns: list[str]) -> str:
    """By meaning, by a shared token, by kind, else from the first tokens."""
    low = [c.lower() for c in columns]
    for words, name in MEANINGS:
        if all(any(w in c for c in low) for w in words):
            return name
    split = [[t for t in re.split(r"[_\W]+", c) if t and t not in STOP] for c in low]
    firsts = Counter(t[0] for t in split if t).most_common(1)
    if firsts and firsts[0][1] >= max(2, len(columns) // 2):
        return plural(firsts[0][0]).capitalize()
    top = Counter(t for ts in split for t in ts).most_common(1)
    if top and top[0][1] >= 2:
        return plural(top[0][0]).capitalize()
    joined = " ".join(low)
    if kind := next((name for words, name in KINDS if any(w in joined for w in words)), None):
        return kind
    tokens = list(dict.fromkeys(t for ts in split for t in ts if len(t) >= 3))[:2]
    return "_".join(t.capitalize() for t in tokens) or "Entity_" + "_".join(c[:4] for c in columns[:2])


def foreign_key(name: str) -> str:
    return f"{name.lower().rstrip('s')}_id"


def entity_table(df: DataFrame, columns: list[str], name: str, order: str) -> DataFrame:
    """Distinct rows with a surrogate key 1..n by first appearance."""
    first = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.min(order).alias("_first"))
    # numbered in two steps: dense places within ranges of the order, so that no single task sorts the table
    return numbered(first, "_first", foreign_key(name)).select(foreign_key(name), *columns)


def numbered(df: DataFrame, order: str, name: str, parts: int = 64) -> DataFrame:
    """1..n by ``order``: rows are ranked within ranges, ranges are offset by the counts before them."""
    cuts = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)]).alias("q")).first()["q"] or []
    edges = F.array(*[F.lit(x) for x in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    ranged = df.withColumn("_range", F.size(F.filter(edges, lambda x: x < F.col(order))))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    base = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # at most 64 rows
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_place", place).join(F.broadcast(base), "_range").withColumn(name, (F.col("_base") + F.col("_place")).cast("long")).drop("_range", "_place", "_base")


def materialize(df: DataFrame, groups: list[dict], order: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(entity tables, fact): the fact has the other columns and a foreign key per entity, joined null-safe."""
    tables, fact = {}, df
    for g in groups:
        t = tables[g["name"]] = entity_table(df, g["columns"], g["name"], order)
        key = foreign_key(g["name"])
        dim = t.select(F.col(key), *[F.col(f"`{c}`").alias(f"_d_{c}") for c in g["columns"]])
        same = None
        for c in g["columns"]:
            one = fact[f"`{c}`"].eqNullSafe(dim[f"`_d_{c}`"])
            same = one if same is None else same & one
        fact = fact.join(dim, same, "left").drop(*g["columns"], *[f"_d_{c}" for c in g["columns"]])
    return tables, fact


def primary_key(df: DataFrame, columns: list[str]) -> str | None:
    """The column that tells at least 98 % of the rows apart, one named like an id first."""
    stats = {r["column"]: r["distinct_values"] / r["rows"] for r in profile.column_stats(df, columns).collect()}
    good = [c for c in columns if stats.get(c, 0) >= HOLDS]
    return next((c for c in good if c.lower().endswith(("id", "_no", "_code"))), good[0] if good else None)


def ddl(df: DataFrame, groups: list[dict], fact: str) -> str:
    """CREATE TABLE statements of the entities and the fact with its foreign keys."""
    stats = {r["column"]: r for r in profile.ddl_stats(df).collect()}
    column = lambda c: f"  {c} {profile.sql_type(df, stats[c], c, TEXT_NAMES)}"
    out, used = [], set()
    for g in groups:
        used.update(g["columns"])
        out.append(f"CREATE TABLE {g['name']} (\n" + ",\n".join([f"  {foreign_key(g['name'])} INTEGER PRIMARY KEY", *map(column, g["columns"])]) + "\n);")
    keys = [f"  {foreign_key(g['name'])} INTEGER REFERENCES {g['name']}({foreign_key(g['name'])})" for g in groups]
    out.append(f"CREATE TABLE {fact} (\n" + ",\n".join([*[column(c) for c in df.columns if c not in used], *keys]) + "\n);")
    return "\n\n".join(out)


def export_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, list[str]]:
    """Each table as CSV files without header under ``folder``, written by tasks; table -> its columns."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{folder}/{name}", quoteAll=True)
    return {name: df.columns for name, df in tables.items()}


def bundle(store: Store, folder: str, columns: dict[str, list[str]], target) -> None:
    """A ZIP of the exported tables, one CSV with a header each, into a path or an open file; files go through in
    pieces."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name, names in columns.items():
            head = io.StringIO()
            csv.writer(head, quoting=csv.QUOTE_ALL, lineterminator="\n").writerow(names)
            with z.open(f"{name}.csv", "w", force_zip64=True) as out:
                out.write(head.getvalue().encode())
                for part in store.names(f"{folder}/{name}"):
                    if part.startswith("part-"):
                        for chunk in store.chunks(f"{folder}/{name}/{part}"):
                            out.write(chunk)


def normalize_all(tables: dict[str, DataFrame], order: str) -> dict[str, tuple[list[dict], dict[str, DataFrame]]]:
    """table -> (its entity groups, entity tables and fact) for every table that holds some."""
    out = {}
    for name, df in tables.items():
        groups = plan_entities(df.drop(order))
        if groups:
            made, fact = materialize(df, groups, order)
            out[name] = groups, made | {f"{name}_fact": fact}
    return out


FEW_COLUMNS, MOST_COLUMNS, FEW_ROWS = 4, 15, 5


def to_masters(df: DataFrame, source: str, order: str, masters: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The master tables with a table's rows added: split into its entities where it holds some, each to the master of
    its first column's entity; else as a whole. Keys that are known, or blank, add no row; new columns are added."""
    data = df.drop(order)
    wide = FEW_COLUMNS <= len(data.columns) <= MOST_COLUMNS and data.limit(FEW_ROWS).count() == FEW_ROWS
    groups = plan_entities(data) if wide else []
    parts = [data.select(*[c for c in data.columns if c in g["columns"]]).distinct() for g in groups] or [data]
    out = dict(masters)
    for part in parts:
        key = part.columns[0]
        table = f"master_{entities.entity_for_key(key, source).lower()}"
        out[table] = master.absorb(out.get(table), part, key)
    return out
