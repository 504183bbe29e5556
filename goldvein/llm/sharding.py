"""Histogram-sort sharding by bytes (operator 8), in DataFrame functions alone.

Rows are ordered by (doc_id, row number of the written light table). Candidate boundaries of that order start as one
range; each round counts rows and exact bytes between neighbouring boundaries over all partitions (a grouped sum with
partial sums: one row per range and task is exchanged), then every range that still matters is cut into ``PROBES``
equal parts: ranges that hold a target (k/shards of all bytes) until they have one row, so splitters are exact, and
ranges with more than ``1 / PARTS`` of the bytes, so that no task gets a large share. A doc_id with many rows is cut
by row number. Texts are read once; the rounds read (doc_id, size) alone. Then the rows are exchanged once, by range;
a row's slot is the number of rows of its shard in the ranges before, plus its place in its range.

The driver holds the ranges: at most ``PROBES * (PARTS + shards)`` per round, whatever the number of rows.

Law: bytes. A splitter stands at the row boundary nearest its target (the lower of two), so shards differ by at most
one row's size. Nulls: a null text counts 1 byte, null doc_ids come first. Repeated rows are placed one by one. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, only

SHARDS, PROBES, PARTS = 8, 64, 256
LOW, HIGH = -(2**63), 2**63 - 1


def light_rows(docs: DataFrame) -> DataFrame:
    """doc_id, key, tie, size, text_crc32 of each row, written: later passes don't touch the texts."""
    text = F.coalesce("text", F.lit(""))
    return cut(
        only(docs, "doc_id", "text").select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("key"),
            F.monotonically_increasing_id().alias("tie"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        ),
        "shard-rows",
    )


def longs(values: list[int]):
    return F.expr("array(" + ", ".join(f"{v}L" if v != LOW else f"cast('{v}' as bigint)" for v in values) + ")")


def with_range(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """``range``: 0-based number of the last bound not above (key, tie), by binary search in the sorted bounds."""
    steps = max(1, (len(bounds) - 1).bit_length())
    keys, ties = longs([b[0] for b in bounds]), longs([b[1] for b in bounds])

    order = F.array(*[F.lit(1 << k) for k in range(steps - 1, -1, -1)])
    return rows.withColumn("range", F.aggregate(order, F.lit(0), lambda at, jump: step(at, jump, keys, ties, len(bounds))))


def step(at, jump, keys, ties, n: int):
    """One halving of the search: go on by ``jump`` if the bound there isn't above the row."""
    to = at + jump
    probe = F.least(to, F.lit(n - 1))
    below = (F.get(keys, probe) < F.col("key")) | ((F.get(keys, probe) == F.col("key")) & (F.get(ties, probe) <= F.col("tie")))
    return F.when((to < n) & below, to).otherwise(at)


def probes(low: tuple[int, int], high: tuple[int, int]) -> list[tuple[int, int]]:
    """Bounds that cut [low, high) into equal parts, by key where it has more than one value inside, else by tie."""
    (a, s), (b, e) = low, high
    top = b - 1 if e == 0 else b  # the largest key inside
    if top > a:
        width = -(-(top - a + 1) // PROBES)
        return [(k, 0) for k in range(a + width, top + 1, width)]
    e = e if b == a else HIGH
    width = -(-(e - s) // PROBES)
    return [(a, t) for t in range(s + width, e, width)] if e - s > 1 else []


def histogram(rows: DataFrame, bounds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(rows, bytes) of each range."""
    got = {r["range"]: (r["n"], r["b"]) for r in with_range(rows, bounds).groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    return [got.get(i, (0, 0)) for i in range(len(bounds))]


def split(rows: DataFrame, shards: int = SHARDS, parts: int = PARTS):
    """(bounds, counts): ranges in which every target falls next to a single row, and none is large."""
    ends = rows.agg(F.min("key"), F.max("key"), F.max("tie"), F.sum("size")).first()
    if ends[0] is None:
        return [], []
    total, bounds, last = ends[3], [(ends[0], 0)], (ends[1], ends[2] + 1)
    counts = histogram(rows, bounds)
    while True:
        new, at = [], 0
        for i, (low, (n, size)) in enumerate(zip(bounds, counts)):
            targets = any(at < t * total / shards < at + size for t in range(1, shards))
            if n > 1 and (targets or size * parts > total):
                new += probes(low, bounds[i + 1] if i + 1 < len(bounds) else last)
            at += size
        if not new:
            return bounds, counts
        bounds = sorted([*bounds, *new])
        counts = histogram(rows, bounds)
        # empty ranges go, and small ones in a row become one again unless a target lies at their border
        bounds, counts = merged(bounds, counts, total, shards, parts)


def merged(bounds, counts, total: int, shards: int, parts: int):
    """Neighbours become one where neither is to be cut again. A range that is keeps both its bounds, tight as they are
    beside empty ranges, so that each round narrows it."""
    out_b, out_c, at, before = [], [], 0, False
    for low, (n, size) in zip(bounds, counts):
        start = at - (out_c[-1][1] if out_c else 0)
        near = lambda a, b: any(a <= t * total / shards <= b for t in range(1, shards))
        again = n > 1 and (size * parts > total or near(at, at + size))
        empty = out_c and (n == 0 or out_c[-1][0] == 0)
        small = out_c and not near(start, at + size) and (out_c[-1][1] + size) * parts <= total
        if out_c and not again and not before and (empty or small):
            out_c[-1] = (out_c[-1][0] + n, out_c[-1][1] + size)
        else:
            out_b.append(low)
            out_c.append((n, size))
            before = again
        at += size
    return out_b, out_c


def shard_plan(counts: list[tuple[int, int]], shards: int = SHARDS) -> tuple[list[int], list[int]]:
    """Per range: its shard, and the rows of that shard before it."""
    total = sum(s for _, s in counts)
    edges, at = [0], 0
    for _, size in counts:
        at += size
        edges.append(at)
    cuts = [min(range(len(edges)), key=lambda i: (abs(edges[i] * shards - t * total), i)) for t in range(1, shards)]
    of = [sum(c <= i for c in cuts) for i in range(len(counts))]
    bases, seen = [], [0] * shards
    for i, (n, _) in enumerate(counts):
        bases.append(seen[of[i]])
        seen[of[i]] += n
    return of, bases


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row."""
    rows = light_rows(docs)
    bounds, counts = split(rows, shards)
    if not bounds:
        bounds, counts = [(LOW, 0)], [(0, 0)]
    of, bases = shard_plan(counts, shards)
    place = F.row_number().over(Window.partitionBy("range").orderBy("key", "tie"))
    return with_range(rows, bounds).withColumn("place", place.cast("long")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
        F.get(F.expr(f"array({', '.join(map(str, of))})"), F.col("range")).cast("int").alias("shard"),
        (F.get(longs(bases), F.col("range")) + F.col("place") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
