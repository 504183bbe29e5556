"""Word n-gram Jaccard join with Bayesian candidate pruning (operator 9).

Words are white-space chunks in lower case without outer punctuation (see ``tokens``); a text's set has its distinct
``SHINGLE``-word shingles as 64-bit hashes (a shorter text has one shingle of all its words). Texts with equal sets are
one node.

1. Signatures: ``BANDS * ROWS`` MinHash values per node. Nodes that agree on a band of ``ROWS`` values are candidates;
   at the threshold a pair escapes all bands with probability (1 - 0.8^4)^27 < 1e-6.
2. Candidate edges run from each node to the smallest node of its bucket, so a bucket of m nodes gives m - 1 rows. The
   connected components of these edges hold all candidate pairs. A component is a unit of comparison; one of more
   than a block whose buckets hold far fewer pairs than the whole is taken bucket by bucket instead, and a pair that
   shares several buckets counts in the first of them alone.
3. A unit is cut into blocks of bounded shingle mass and number by hash; each pair of blocks is a task of its own. In it,
   the signatures of all pairs are compared ``STEP`` values at a time; after n values with m agreements, a pair goes
   when the posterior probability (uniform prior) that its similarity reaches the threshold, which is the binomial
   tail P(Bin(n + 1, t) <= m), falls below ``TOLERANCE``. The rest is verified exactly on the shingle sets.
4. A task returns, per node, how many nodes and documents it is linked to, and one edge to its local class: pairs are
   never written out, yet each link is counted. Classes are the components of these edges.

Result, one row per input row: doc_id, class_id (the smallest doc_id of the class), n_links (other rows with a
similarity of at least the threshold, equal sets included), n_linked_sets (different sets linked), class_size.

Nulls and ties: null, empty and wordless texts have no shingles: each such row is a class of its own (class_id is its
doc_id) without links. Null doc_ids take part; a class without any doc_id has a null class_id. Rows are told apart by
doc_id and text, not by doc_id alone. Repeated rows are copies of each other. Very long texts are taken whole. Other
columns, whatever their names, are left alone. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import bounded, cut, only

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS = 4, 27
STEP, TOLERANCE = 12, 1e-7
BLOCK_MASS, BLOCK_NODES = 1_000_000, 2_048
#: A component of several blocks is taken by buckets if they hold less than this share of its pairs.
SPARSE = 0.25


def shingle_sets(texts) -> list[np.ndarray]:
    """The sorted distinct shingles of each text of an array, as unsigned 64-bit hashes."""
    w = tokens.words(texts)
    rows = tokens.windows(w.hash, SHINGLE)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        out.append(np.unique(rows[a : b - SHINGLE + 1]) if b - a >= SHINGLE else tokens.windows(w.hash[a:b], b - a) if b > a else w.hash[:0])
    return out


def multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    return rng.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, count, dtype=np.uint32)


def signature(sh: np.ndarray, ab=None) -> np.ndarray:
    """MinHash values (unsigned 32-bit) of a shingle set."""
    a, b = ab or multipliers(BANDS * ROWS)
    x = (sh ^ (sh >> np.uint64(32))).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        v = np.multiply.outer(a, x[i : i + 2048])
        v += b[:, None]
        v ^= v >> np.uint32(15)
        np.minimum(best, v.min(axis=1), out=best)
    return best


def set_key(sh: np.ndarray) -> bytes:
    return hashlib.blake2b(sh.tobytes(), digest_size=16).digest()


def least_agreements(n: int, t: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest agreements in n values with which a pair stays."""
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def sketch(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, tk (a hash of the text), and if it has words node (16 bytes), mass (number of shingles), sig."""

    def run(batches):
        import pyarrow as pa

        ab = multipliers(BANDS * ROWS)
        for b in batches:
            for at, texts in tokens.slices(b.column(2)):
                rows = [(set_key(sh), len(sh), signature(sh, ab).tobytes()) if len(sh) else (None, 0, None) for sh in shingle_sets(texts)]
                kinds = (pa.binary(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(rows)), b.column(1).slice(at, len(rows))] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "tk", "node", "mass", "sig"])

    return keyed(docs).select("doc_id", "tk", "text").mapInArrow(run, "doc_id long, tk long, node binary, mass long, sig binary")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and tk, a hash of the text: rows are told apart by doc_id and tk."""
    bounded(docs.sparkSession)
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tk"))


def band_rows(nodes: DataFrame) -> DataFrame:
    """node, sig -> (bucket, band, node), one row per band; the band's number is part of the bucket."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keys = b.column("node").to_pylist()
            if not keys:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(len(keys), BANDS, ROWS).astype(np.uint64)
            with np.errstate(over="ignore"):
                h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95), sig.shape[:2]).copy()
                for r in range(ROWS):
                    h = (h ^ sig[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(31)
            at = pa.array(np.repeat(np.arange(len(keys), dtype=np.int32), BANDS))
            band = pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), band, pa.array(keys, pa.binary()).take(at)], ["bucket", "band", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "bucket long, band int, node binary")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(a, b) edges, a > b -> (node, root), root the smallest node of the component.

    Hooking and pointer jumping: every node takes the smallest root among its neighbours' roots, then its root's
    root, until nothing changes; rounds grow with the logarithm of the longest path. Each round is written. What is
    grouped is written before it is joined, so that a join on a hot root stands alone and is split or broadcast."""
    both = cut(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), f"{name}-edges")
    roots = cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("root")), f"{name}-roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("low"))
        # hook the old root onto the smallest root seen by any of its nodes
        hooked = cut(roots.join(near, "node").select("node", "root", F.least("root", "low").alias("low")), f"{name}-hooked")
        hook = cut(hooked.groupBy("root").agg(F.min("low").alias("up")).filter("up < root").select(F.col("root").alias("old"), "up"), f"{name}-hook")
        step = cut(hooked.join(hook, hooked.root == hook.old, "left").select("node", "root", F.least("low", F.coalesce("up", "low")).alias("new")), f"{name}-step")
        jump = step.select(F.col("node").alias("at"), F.col("new").alias("far")).filter("at <> far")
        after = cut(step.join(jump, step.new == jump.at, "left").select("node", F.least("new", F.coalesce("far", "new")).alias("root"), F.col("root").alias("was")), f"{name}-roots")
        roots = after.select("node", "root")
        if not after.filter(F.col("root") != F.col("was")).limit(1).count():
            return roots


def compare_blocks(items: list[tuple], same: bool, t: float = THRESHOLD, band: int = -1):
    """items: (node, side, copies, sig, shingles) -> per node (links to nodes, links to documents, local root).

    If ``same``, all pairs within the items; else those of one item of either side. With a band given, only pairs whose
    first common band it is. Memory: the items and one row of the pair matrix per step."""
    n = len(items)
    side = np.array([x[1] for x in items])
    copies = np.array([x[2] for x in items], np.int64)
    sig = np.stack([np.frombuffer(x[3], np.uint32) for x in items])
    sets = [np.frombuffer(x[4], np.uint64) for x in items]
    sizes = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flags = np.zeros(int(flat.max()) + 1, np.int64)
    least = {k: least_agreements(k, t) for k in range(STEP, sig.shape[1] + 1, STEP)}
    n_sets, n_docs, root = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n - 1):
        j = np.arange(i + 1, n)
        if not same:
            j = j[side[j] != side[i]]
        # similarity can't exceed the ratio of sizes
        j = j[np.minimum(sizes[j], sizes[i]) >= t * np.maximum(sizes[j], sizes[i])]
        agree = np.zeros(len(j), np.int64)
        for k in range(0, sig.shape[1], STEP):
            if not len(j):
                break
            agree = agree + (sig[j, k : k + STEP] == sig[i, k : k + STEP]).sum(axis=1)
            if k + STEP in least:
                stay = agree >= least[k + STEP]
                j, agree = j[stay], agree[stay]
        if band >= 0 and len(j):
            common = (sig[j] == sig[i]).reshape(len(j), BANDS, ROWS).all(axis=2)
            j = j[common[:, band] & (common.argmax(axis=1) == band)]
        if not len(j):
            continue
        flags[flat[starts[i] : starts[i + 1]]] = 1
        lens = sizes[j]
        at = np.repeat(starts[j] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        common = np.add.reduceat(flags[flat[at]], np.concatenate([[0], np.cumsum(lens)[:-1]]))
        flags[flat[starts[i] : starts[i + 1]]] = 0
        linked = j[common >= t * (sizes[i] + lens - common) - 1e-9]
        if len(linked):
            n_sets[i] += len(linked)
            n_docs[i] += copies[linked].sum()
            n_sets[linked] += 1
            n_docs[linked] += copies[i]
            for x in linked.tolist():
                a, b = find(i), find(x)
                if a != b:
                    root[max(a, b)] = min(a, b)
    return [(items[k][0], int(n_sets[k]), int(n_docs[k]), items[find(k)][0]) for k in range(n)]


def link_rows(work: DataFrame, t: float) -> DataFrame:
    """work: (unit, band, bi, bj, side, node, copies, sig, sh) -> (node, n_sets, n_docs, root) per task and node."""

    def run(batches):
        import pyarrow as pa

        now, held, out = None, [], []

        def done():
            if len(held) > 1:
                out.extend(compare_blocks(held, now[1] == now[2], t, now[3]))
            held.clear()

        def batch():
            got = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], x) for k, x in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.binary()))], ["node", "n_sets", "n_docs", "root"])
            out.clear()
            return got

        for b in batches:
            for unit, bi, bj, band, side, node, copies, sig, sh in zip(*(c.to_pylist() for c in b.columns)):
                if (unit, bi, bj, band) != now:
                    done()
                    now = (unit, bi, bj, band)
                if not held or held[-1][0] != node:  # rows that repeat both doc_id and text give the same node again
                    held.append((node, side, copies, sig, sh))
            if out:
                yield batch()
        done()
        if out:
            yield batch()

    dealt = work.select("unit", "bi", "bj", "band", "side", "node", "copies", "sig", "sh").repartition("unit", "bi", "bj").sortWithinPartitions("unit", "bi", "bj", "side", "node")
    return dealt.mapInArrow(run, "node binary, n_sets long, n_docs long, root binary")


def with_shingles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (node, rep, tk) -> (node, sh), its shingles computed again from the text of a row of doc_id rep and hash tk."""
    texts = keyed(docs).select(F.col("doc_id").alias("rep"), "tk", "text").alias("d")
    w = wanted.select("node", "rep", "tk").alias("w")
    joined = texts.join(w, F.expr("d.tk = w.tk and d.rep <=> w.rep")).select("w.node", "d.text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at, texts in tokens.slices(b.column(1)):
                sets, nodes = shingle_sets(texts), b.column(0).slice(at, len(texts))
                keep = pa.array([set_key(s) == n for s, n in zip(sets, nodes.to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([nodes.filter(keep), pa.array([s.tobytes() for s in sets], pa.binary()).filter(keep)], ["node", "sh"])

    return joined.mapInArrow(run, "node binary, sh binary")


def units(nodes: DataFrame) -> DataFrame:
    """(unit, band, node): the groups in which all pairs are compared; band is -1 for whole components."""
    bands = band_rows(nodes)
    heads = cut(bands.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("m")).filter("m > 1"), "buckets")
    shared = cut(bands.join(heads, "bucket"), "shared")
    edges = shared.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    comps = components(edges, "candidates")
    sizes = comps.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK_NODES)
    pairs = heads.join(comps.withColumnRenamed("node", "head"), "head").groupBy("root").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("pairs"))
    sparse = cut(sizes.join(pairs, "root").filter(F.col("pairs") < SPARSE * F.col("n").cast("double") * F.col("n")).select("root"), "sparse")
    whole = comps.join(sparse, "root", "left_anti").select(F.col("root").alias("unit"), F.lit(-1).alias("band"), "node")
    split = shared.join(comps.join(sparse, "root", "left_semi").select("node"), "node", "left_semi")
    return whole.unionByName(split.select(F.encode(F.col("bucket").cast("string"), "UTF-8").alias("unit"), "band", "node"))


def classes(docs: DataFrame, t: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and per node its copies, root (of its class), n_sets and n_docs."""
    rows = cut(sketch(docs), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk"))
    nodes = rows.filter("node is not null").groupBy("node").agg(first.alias("rep"), F.count("*").alias("copies"), F.first("mass").alias("mass"), F.first("sig").alias("sig"))
    nodes = cut(nodes.select("node", F.col("rep.doc_id").alias("rep"), F.col("rep.tk").alias("tk"), "copies", "mass", "sig"), "nodes")
    members = cut(units(nodes).join(nodes.select("node", "mass"), "node"), "members")
    masses = members.groupBy("unit").agg(F.sum("mass").alias("total"), F.count("*").alias("n"))
    masses = cut(masses.select("unit", F.greatest(F.lit(1), F.ceil(F.col("total") / BLOCK_MASS), F.ceil(F.col("n") / BLOCK_NODES)).cast("int").alias("blocks")).filter("blocks > 1"), "blocks")
    placed = members.join(masses, "unit", "left").select("unit", "band", "node", F.coalesce("blocks", F.lit(1)).alias("blocks")).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    used = nodes.join(members.select("node").distinct(), "node", "left_semi")
    sets = with_shingles(docs, used)
    work = placed.join(nodes.select("node", "copies", "sig"), "node").join(sets, "node")
    # each block meets every block: the pair's smaller number first
    work = work.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "unit", "band", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "copies", "sig", "sh"
    )
    links = cut(link_rows(work, t), "links")
    roots = components(links.filter("node <> root").select(F.greatest("node", "root").alias("a"), F.least("node", "root").alias("b")), "classes")
    counts = links.groupBy("node").agg(F.sum("n_sets").alias("n_sets"), F.sum("n_docs").alias("n_docs"))
    named = nodes.select("node", "rep", "tk", "copies").join(roots, "node", "left").join(counts, "node", "left")
    return rows, cut(named.withColumn("root", F.coalesce("root", "node")), "named")


def jaccard_join(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, n_linked_sets, class_size."""
    rows, named = classes(docs, t)
    ids = cut(named.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size")), "classes")
    facts = named.join(ids, "root").select("node", "copies", "class_id", "class_size", "n_sets", "n_docs")
    return rows.select("doc_id", "node").join(facts, "node", "left").select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("n_docs") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_sets", F.lit(0)).cast("long").alias("n_linked_sets"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )


def keep_one(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with one row left of each class: that of the smallest doc_id (null ones last), of several
    such that of the smallest hash of the text, of equal ones any. Rows without words all stay."""
    rows, named = classes(docs, t)
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "tk")).alias("first")
    firsts = named.groupBy("root").agg(first).select(F.col("first.rep").alias("rep"), F.col("first.tk").alias("tk"))
    # rows that repeat both doc_id and text: only those are put side by side to choose one
    often = rows.filter("node is not null").groupBy("doc_id", "tk").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("rep"), "tk", F.lit(True).alias("twice"))
    keep = firsts.alias("f").join(often.alias("o"), F.expr("f.tk = o.tk and f.rep <=> o.rep"), "left").select("f.rep", "f.tk", F.coalesce("twice", F.lit(False)).alias("twice"))
    bare = rows.filter("node is null").select(F.col("doc_id").alias("rep"), "tk", F.lit(False).alias("twice")).distinct()
    keep = cut(keep.unionByName(bare), "kept").alias("k")
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["`doc_id`"].cast("long").alias("rep"), F.xxhash64(docs["`text`"]).alias("tk")).alias("d")
    kept = packed.join(keep, F.expr("d.tk = k.tk and d.rep <=> k.rep")).select("row", "d.rep", "d.tk", "twice")
    one = kept.filter("twice").dropDuplicates(["rep", "tk"]).select("row.*")
    return kept.filter("not twice").select("row.*").unionByName(one)
