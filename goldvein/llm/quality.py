"""Quality rules with adaptive thresholds (operator 2).

Per row, measures of the whole text: words are runs of anything but ASCII white space. Shares of symbols, capitals,
repeated lines, words in repeated 5-word windows, and exclamation and question marks, and the mean word length, are held
against fences of the row's own language and source instead of fixed cutoffs; word length from below too. The fences come from quantile sketches: counts per logarithmic bin
(relative error ``1 / BINS_PER_E``), which are exact under merging and don't depend on order or partitioning. The
sketches of all (language, source) pairs are merged into those of languages and of the whole; a pair with fewer than
``LEAST_ROWS`` rows uses its language's fences, and that, if small too, the whole's. A fence never passes
``WIDEST`` times its language's, so a source that is mostly junk can't declare junk normal.

A fence is ``max(floor, median + SPREAD * max(third quartile - median, REL * median))``, the one from below
``min(median - floor, median - SPREAD * max(median - first quartile, REL * median))``.

Nulls and ties: a null text has no words; a null language or source is a group like any other; repeated rows count as
often as they come. Empty table: no rows. Documents without words fail the base rules. Very long texts are measured
whole. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, only

WINDOW = 5
SYMBOLS = "#*$%&|<>"
BINS_PER_E = 20
LEAST_ROWS, SPREAD, REL, WIDEST = 300, 12.0, 0.02, 2.0
#: measure -> tolerance: a fence is never below it, as most groups have no symbol or repeated line at all
#: (millionths; word length in thousandths of a character). Small, so that a group's quantiles decide where they aren't
#: zero; a line that comes twice among three is tolerated, as the sketch of a group mostly without any can't judge it.
FLOORS = {"symbol_ppm": 1_000, "upper_ppm": 1_000, "dup_line_ppm": 350_000, "word_mil": 100, "mark_ppm": 1_000, "repeat_ppm": 180_000}
#: the measures held from below too
LOW = ("word_mil",)


def measure(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks (! and ?), n_lines of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    gaps = sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return len(words), len(text) - gaps, sum(map(text.count, SYMBOLS)), dup, repeated(words), upper, text.count("!") + text.count("?"), lines


def repeated(words: list[bytes]) -> int:
    """Words in windows of 5 that come twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    at = ids[:n]
    for i in range(1, WINDOW):  # pairs (window so far, next word) get dense numbers: no hash, no collision
        at = at * len(number) + ids[i : i + n]
        if i < WINDOW - 1:
            at = np.unique(at, return_inverse=True)[1]
    _, inverse, counts = np.unique(at, return_inverse=True, return_counts=True)
    first = np.flatnonzero(counts[inverse] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines"]


def measures(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns and COUNTS of each row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [measure(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in carry] + [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS))], [*carry, *COUNTS]
            )

    bounded(docs.sparkSession)
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carry] + [f"{c} long" for c in COUNTS])
    return only(docs, *dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)


def scored(rows: DataFrame) -> DataFrame:
    """base_failed and the measures that the fences hold for; integer arithmetic, so that any engine agrees."""
    per = lambda a, b, unit: F.expr(f"case when {b} > 0 then {a} * {unit} div {b} else 0 end")
    return rows.withColumns({
        "base_failed": F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"),
        "symbol_ppm": per("n_symbols", "word_chars", 1_000_000),
        "upper_ppm": per("n_upper", "word_chars", 1_000_000),
        "dup_line_ppm": per("n_dup_lines", "n_lines", 1_000_000),
        "word_mil": per("word_chars", "n_words", 1_000),
        "mark_ppm": per("n_marks", "word_chars", 1_000_000),
        "repeat_ppm": per("n_repeat_words", "n_words", 1_000_000),
    })


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): mergeable quantile sketches of the rows that pass the base rules."""
    long = rows.filter("not base_failed").select("lang", "source", F.expr("stack(%d, %s) as (measure, value)" % (len(FLOORS), ", ".join(f"'{m}', {m}" for m in FLOORS))))
    binned = long.withColumn("bin", F.expr(f"cast(round(ln(1 + value) * {BINS_PER_E}) as int)"))
    return binned.groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))


def fences(sk: DataFrame) -> DataFrame:
    """(lang, source, max_ and for LOW min_ columns): the fences of each pair, from its sketch or those merged above it."""
    merged = (
        sk.withColumn("level", F.lit(2)).unionByName(sk.withColumns({"source": F.lit(None).cast("string"), "level": F.lit(1)}))
        .unionByName(sk.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "level": F.lit(0)}))
        .groupBy("level", "lang", "source", "measure", "bin").agg(F.sum("n").alias("n"))
    )
    # a group has at most a few hundred bins, whatever its rows
    of = merged.groupBy("level", "lang", "source", "measure").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))
    quantile = lambda q: F.expr(
        f"aggregate(bins, named_struct('seen', 0L, 'at', cast(null as int)), (a, x) -> named_struct('seen', a.seen + x.n, 'at', case when a.at is null and a.seen + x.n >= total * {q} then x.bin else a.at end)).at"
    )
    value = lambda c: F.expr(f"exp({c} / {float(BINS_PER_E)}) - 1")
    q = of.withColumns({"d": quantile(0.25), "m": quantile(0.5), "u": quantile(0.75)}).withColumns({c: value(c) for c in "dmu"})
    floor = F.element_at(F.create_map(*[F.lit(x) for kv in FLOORS.items() for x in kv]), F.col("measure"))
    q = q.withColumn("fence", F.greatest(floor.cast("double"), F.col("m") + SPREAD * F.greatest(F.col("u") - F.col("m"), REL * F.col("m"))))
    q = q.withColumn("low", F.least(F.col("m") - floor, F.col("m") - SPREAD * F.greatest(F.col("m") - F.col("d"), REL * F.col("m"))))
    wide = lambda level: q.filter(F.col("level") == level)
    pair, lang, whole = wide(2).alias("p"), wide(1).alias("l"), wide(0).alias("w")
    both = (
        pair.join(lang, F.expr("p.lang <=> l.lang and p.measure = l.measure")).join(whole, F.expr("p.measure = w.measure"))
        .withColumn("above", F.expr(f"case when l.total >= {LEAST_ROWS} then l.fence else w.fence end"))
        .withColumn("below", F.expr(f"case when l.total >= {LEAST_ROWS} then l.low else w.low end"))
        .withColumn("use", F.expr(f"case when p.total >= {LEAST_ROWS} then least(p.fence, {WIDEST} * above) else above end"))
        .withColumn("use_low", F.expr(f"case when p.total >= {LEAST_ROWS} then greatest(p.low, below / {WIDEST}) else below end"))
    )
    return both.groupBy("p.lang", "p.source").pivot("p.measure", list(FLOORS)).agg(F.max("use").alias("max"), F.max("use_low").alias("min")).select(
        F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *[F.col(f"{m}_max").alias(f"max_{m}") for m in FLOORS], *[F.col(f"{m}_min").alias(f"min_{m}") for m in LOW]
    )


#: a condition on a row beside its pair's fences
INSIDE = " and ".join([*(f"({m} <= max_{m} or max_{m} is null)" for m in FLOORS), *(f"({m} >= min_{m} or min_{m} is null)" for m in LOW)])


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` (scored, written) with the fences of their pair and ``kept``. One row per pair joins: small beside the
    rows, so Spark broadcasts it by its size or splits a hot pair of a shuffled join."""
    limits = fences(sketches(rows))
    return rows.join(limits, F.expr("lang <=> f_lang and source <=> f_source"), "left").withColumn("kept", F.expr(f"not base_failed and {INSIDE}"))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, the measures, their fences and kept, for each row."""
    rows = cut(scored(measures(docs, ["doc_id", "lang", "source"])), "quality")
    return judged(rows).drop("f_lang", "f_source")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with their own columns.

    Rows are judged where they stand: a second pass measures and holds them against the joined fences, so whole texts
    aren't shuffled and rows that repeat a doc_id are told apart."""
    names = docs.columns
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), "lang", "source", "text")
    rows = cut(scored(measures(docs, ["lang", "source"])), "quality")
    limits = fences(sketches(rows))
    again = scored(measures(packed, ["row", "lang", "source"]))
    kept = again.join(limits, F.expr("lang <=> f_lang and source <=> f_source"), "left").filter(f"not base_failed and {INSIDE}")
    return kept.select("row.*")
