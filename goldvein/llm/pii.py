"""Personal data: fixed patterns, and bootstrapped contextual extraction (operator 10), in DataFrame functions alone.

Base kinds (email, ip, card, phone) are found leftmost and non-overlapping per kind. A pattern's matches are marked in
the text and split off; their places are running sums of the lengths (in code points) of the pieces. The patterns are
written so that Java's engine takes linear time: runs are possessive and start only at a run's start or where the
last match ended. Running values are taken in blocks of ``BLOCK``, so a text of very many matches takes little more
than linear time.

Bootstrapping. Seeds are the base entities. A lexical pattern is the pair of words before (L) or after (R) an
identifier, both whole within ``REACH`` characters; there is none where a word reaches further. Candidates are tokens of
``LEAST_CHARS`` and more characters with ``LEAST_DIGITS`` and more digits in the text without base spans. Then
``ROUNDS`` times: a pattern's confidence is the summed score of the known strings beside it, by occurrence, over all
occurrences of the pair in the corpus, so ordinary words in the place of an identifier count against it. Patterns of
confidence ``ACCEPT`` and more beside ``LEAST_SEEDS`` different known strings, whatever the size of the corpus, are
accepted; candidates beside them become known, with the pattern's confidence as score (seeds have 1), and are the seeds
of further patterns in the next round. Candidates beside a pattern accepted at last are added as kind ``context``.

All counts cover all documents; the pattern-instance graph stays in tables, of no more files than partitions are read
for them, whatever the number of shuffle partitions. A pair is counted over the whole corpus
only if its occurrences in documents with an identifier, of which there can only be more, leave its confidence a
chance; this drops no pattern that could be accepted.

Nulls and ties: a null text is an empty one. Rows that share a doc_id are told apart by a row number in the written
table. Other columns, whatever their names, are left alone. Empty table: no rows. U+0001 in a text is read as U+0002,
which no pattern matches either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, narrowed, only

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can match at all.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
TOKEN = r"(?<![^\s])[^\s0-9]*+[0-9][^\s]*+"
LEAST_CHARS, LEAST_DIGITS = 6, 4
LEAST_SEEDS, ROUNDS, ACCEPT = 3, 3, 0.6
REACH = 120
BLOCK, PIECE = 128, 8_192


def pieces(text: Column, pattern: str, hint: str) -> Column:
    """The text split at the pattern's matches: matches stand at odd places (from 0)."""
    marked = F.split(F.regexp_replace(text, pattern, "\x01$0\x01"), "\x01", -1)
    return F.when(text.rlike(hint), marked).otherwise(F.array(text))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, op) -> Column:
    """Running values of an array that isn't empty: within blocks, from the value of the blocks before."""
    at = lambda n: F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))

    def with_blocks(v, blocks):
        bases = F.transform(at(F.size(v)), lambda b: F.aggregate(F.slice(blocks, F.lit(1), b), zero, op))

        def item(base):
            block = lambda i: F.floor(i / BLOCK).cast("int")
            return F.transform(v, lambda _, i: F.aggregate(F.slice(v, block(i) * BLOCK + 1, i % BLOCK + 1), F.get(base, block(i)), op))

        return let(bases, item)

    return let(values, lambda v: let(F.transform(at(F.size(v)), lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), zero, op)), lambda blocks: with_blocks(v, blocks)))


SPAN = "struct<start:int,end:int,s:string,at:int>"


def found(parts: Column) -> Column:
    """array<struct<start, end, s, at>> of the odd pieces; ``at`` is a piece's place."""
    lens = F.transform(parts, lambda p: F.length(p))
    item = lambda ends, i: F.struct((F.get(ends, i) - F.length(F.get(parts, i))).alias("start"), F.get(ends, i).alias("end"), F.get(parts, i).alias("s"), i.alias("at"))
    spans = let(running(lens, F.lit(0), lambda a, n: a + n), lambda ends: F.transform(F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)), lambda i: item(ends, i)))
    return F.when(F.size(parts) > 1, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9]", "")
    if kind == "ip":
        return s.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def checker(kind: str):
    return lambda x: valid(kind, x["s"])


def blanked(kind: str):
    """Of pieces by place: those that are valid matches become line feeds, as many as characters."""
    return lambda p, i: F.when((i % 2 == 1) & valid(kind, p), F.repeat(F.lit("\n"), F.length(p))).otherwise(p)


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def pair(w: Column) -> Column:
    """Hash of a two-word array; null for a shorter one."""
    return F.when(F.size(w) == 2, F.xxhash64(F.get(w, F.lit(0)), F.get(w, F.lit(1))))


def contexts(parts: Column, at: Column) -> tuple[Column, Column]:
    """A piece's lexical patterns: hashes of the two words before and after it, from its neighbours."""
    inside, blank = r"[\p{L}\p{N}]+", F.lit("")
    before = F.concat(F.coalesce(F.get(parts, at - 2), blank), F.get(parts, at - 1))
    after = F.concat(F.get(parts, at + 1), F.coalesce(F.get(parts, at + 2), blank))
    # a word that reaches over the end may be cut: it makes no pattern
    before = F.when(F.length(before) > REACH, F.regexp_replace(F.substring(before, -REACH, REACH), f"^{inside}", "")).otherwise(before)
    after = F.when(F.length(after) > REACH, F.regexp_replace(F.substring(after, 1, REACH), f"{inside}$", "")).otherwise(after)
    left = let(words(before), lambda w: pair(F.when(F.size(w) >= 2, F.slice(w, -2, 2)).otherwise(w)))
    return left, pair(F.slice(words(after), 1, 2))


ITEM = "struct<start:int,end:int,s:string,left:bigint,right:bigint>"


def with_context(parts: Column, spans: Column) -> Column:
    def item(x):
        left, right = contexts(parts, x["at"])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lower(x["s"]).alias("s"), left.alias("left"), right.alias("right"))

    return F.when(F.size(spans) > 0, F.transform(spans, item)).otherwise(F.array().cast(f"array<{ITEM}>"))


def pairs(text: Column) -> Column:
    """The hashes of all neighbouring words."""
    both = lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.xxhash64(a, b))
    return let(words(text), lambda w: F.when(F.size(w) > 1, both(w)))


def extract(docs: DataFrame, carry: dict[str, Column]) -> DataFrame:
    """row, the carried columns, one array of spans per base kind, seeds and candidates with contexts, and for rows with
    such the word pairs of the text; written."""
    d = docs.select(*[c.alias(n) for n, c in carry.items()], F.monotonically_increasing_id().alias("_row"), F.translate(F.coalesce(docs["`text`"], F.lit("")), "\x01", "\x02").alias("_t"))
    t = F.col("_t")
    d = d.withColumns({f"_p_{k}": pieces(t, PATTERNS[k], HINTS[k]) for k in KINDS})
    d = d.withColumns({f"_{k}": F.filter(found(F.col(f"_p_{k}")), checker(k)) for k in KINDS})
    any_base = F.size("_email") + F.size("_ip") + F.size("_card") + F.size("_phone") > 0
    # candidates are looked for where base spans are blanked
    d = d.withColumns({"_any": any_base, "_rest": t})
    for k in KINDS:
        d = d.withColumn("_rest_parts", F.when(F.col("_any"), pieces(F.col("_rest"), PATTERNS[k], HINTS[k])))
        d = d.withColumn("_rest", F.when(F.col("_any"), F.array_join(F.transform("_rest_parts", blanked(k)), "")).otherwise(F.col("_rest")))
    d = d.withColumn("_p_token", pieces(F.col("_rest"), TOKEN, r"[0-9]"))
    tokens = F.filter(
        F.transform(found(F.col("_p_token")), trimmed),
        lambda x: (F.length(x["s"]) >= LEAST_CHARS) & (F.length(F.regexp_replace(x["s"], "[^0-9]", "")) >= LEAST_DIGITS),
    )
    d = d.withColumns({"_tokens": tokens, "_seeds": F.concat(*[with_context(F.col(f"_p_{k}"), F.col(f"_{k}")) for k in KINDS])})
    d = d.withColumn("_more", with_context(F.col("_p_token"), F.col("_tokens")))
    d = d.withColumn("_pairs", F.when(F.col("_any") | (F.size("_more") > 0), pairs(t)))
    return cut(d.select("_row", *carry, *[f"_{k}" for k in KINDS], "_seeds", "_more", "_pairs"), "pii")


def trimmed(x: Column) -> Column:
    """A token without outer punctuation."""
    head = F.length(x["s"]) - F.length(F.regexp_replace(x["s"], r"^[^\p{L}\p{N}+]++", ""))
    s = F.regexp_replace(x["s"], r"^[^\p{L}\p{N}+]++|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    return F.struct((x["start"] + head).alias("start"), (x["start"] + head + F.length(s)).alias("end"), s.alias("s"), x["at"].alias("at"))


def sides(x: str) -> Column:
    return F.explode(F.array(F.struct(F.lit("L").alias("side"), F.col(f"{x}.left").alias("pattern")), F.struct(F.lit("R").alias("side"), F.col(f"{x}.right").alias("pattern")))).alias("p")


def counted(pair_arrays: DataFrame, patterns: DataFrame, name: str) -> DataFrame:
    """(pattern, name): how often each of the patterns stands in the arrays of one column."""
    each = pair_arrays.select(F.explode(pair_arrays.columns[0]).alias("pattern"))
    return each.join(patterns.select("pattern").distinct(), "pattern").groupBy("pattern").agg(F.count("*").alias(name))


def accepted(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(side, pattern) of the patterns accepted after the rounds."""
    of = lambda column, seed: rows.select(F.explode(column).alias("x")).select("x.s", sides("x")).select("p.side", "p.pattern", "s", F.lit(seed).alias("seed"))
    beside = of("_seeds", True).unionByName(of("_more", False)).filter("pattern is not null")
    edges = beside.groupBy("side", "pattern", "s").agg(F.count("*").alias("n"), F.max("seed").alias("seed"), F.max(~F.col("seed")).alias("fresh"))
    edges = cut(narrowed(edges, rows), "pii-edges")
    small = lambda df, name: cut(narrowed(df, edges), name)
    # a pattern without a candidate can add none; one with too few strings is never accepted
    able = edges.groupBy("side", "pattern").agg(F.count("*").alias("strings"), F.sum("n").alias("n"), F.max("fresh").alias("fresh")).filter(f"fresh and strings >= {LEAST_SEEDS}")
    able = small(able.select("side", "pattern", "n"), "pii-able")
    least = counted(rows.select("_pairs"), able, "least")
    able = small(able.join(least, "pattern", "left").filter(f"n >= {ACCEPT} * coalesce(least, 0)").select("side", "pattern"), "pii-patterns")
    totals = counted(only(docs, "text").select(pairs(F.coalesce("text", F.lit(""))).alias("w")), able, "total")
    known = edges.groupBy("s").agg(F.max("seed").alias("seed"))  # a string that is a seed anywhere is one everywhere
    graph = small(edges.drop("seed", "fresh").join(able, ["side", "pattern"]).join(totals, "pattern").join(known, "s"), "pii-graph")
    score = graph.filter("seed").select("s", F.lit(1.0).alias("score")).distinct()
    good = None
    for i in range(ROUNDS):
        conf = graph.join(score, "s").groupBy("side", "pattern").agg((F.sum(F.col("score") * F.col("n")) / F.max("total")).alias("conf"), F.count("*").alias("strings"))
        good = small(conf.filter(f"conf >= {ACCEPT} and strings >= {LEAST_SEEDS}").select("side", "pattern", F.least("conf", F.lit(1.0)).alias("conf")), "pii-good")
        if i + 1 < ROUNDS:
            reached = graph.join(good, ["side", "pattern"], "left").filter("seed or conf is not null")
            score = small(reached.groupBy("s").agg(F.max(F.when(F.col("seed"), 1.0).otherwise(F.col("conf"))).alias("score")), "pii-score")
    return good.select("side", "pattern")


def discovered(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(_row, _context): spans of the candidates that stand beside an accepted pattern, by start."""
    good = accepted(rows, docs)
    c = rows.select("_row", F.explode("_more").alias("x")).select("_row", "x.start", "x.end", "x.s", sides("x"))
    hit = c.select("_row", "start", "end", "s", "p.side", "p.pattern").join(good, ["side", "pattern"], "left_semi")
    return hit.groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("start", "end", "s"))).alias("_context"))


def text_of(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))


def with_spans(docs: DataFrame, carry: dict[str, Column]) -> DataFrame:
    """The extracted rows with ``_context``. Rows without a candidate, nearly all, aren't shuffled."""
    rows = extract(docs, carry)
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    able = rows.filter("size(_more) > 0").join(discovered(rows, docs), "_row", "left").withColumn("_context", F.coalesce("_context", none))
    return narrowed(able, rows).unionByName(rows.filter("size(_more) = 0").withColumn("_context", none))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context for each row."""
    d = with_spans(docs, {"doc_id": docs["`doc_id`"]})
    base = F.concat(*[text_of(k, F.col(f"_{k}")) for k in KINDS])
    return d.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, text_of("context", F.col("_context"))), ",").alias("spans"),
        F.size("_context").cast("long").alias("n_context"),
    )


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with ``spans`` (start, back = -end, tag; sorted, not empty) replaced by their tags, overlapping ones by
    the first one's. The text is cut into pieces of ``PIECE`` characters first, as a place in it is found by counting."""
    n = F.length(text)
    cuts = F.transform(F.sequence(F.lit(0), F.floor(n / PIECE).cast("int")), lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE)))

    def between(p, a, b):
        i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        near = F.substring(F.get(p, i), a % PIECE + 1, b - a)
        far = F.concat(F.substring(F.get(p, i), a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(p, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.get(p, j), F.lit(1), b % PIECE))
        return F.when(i == j, near).otherwise(far)

    def done(p, reach, heads):
        """heads: the places of spans that begin beyond all before them; reach: the furthest end so far."""
        before = lambda k: F.when(k == 0, 0).otherwise(F.get(reach, F.get(heads, k) - 1))
        one = lambda h, k: F.concat(between(p, before(k), F.get(spans, h)["start"]), F.get(spans, h)["tag"])
        return F.concat(F.array_join(F.transform(heads, one), ""), between(p, F.get(reach, F.size(reach) - 1), n))

    ends = F.transform(spans, lambda x: -x["back"])
    heads = lambda reach: F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(reach, i - 1)))
    return let(cuts, lambda p: let(running(ends, F.lit(0), lambda a, b: F.greatest(a, b)), lambda reach: let(heads(reach), lambda h: done(p, reach, h))))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in its text replaced by its kind in angle brackets; overlapping spans become one, named
    after the first. Texts without a span, null ones included, stay as they are."""
    names = docs.columns
    d = with_spans(docs, {"_doc": F.struct(*[docs[f"`{c}`"] for c in names])})
    tagged = lambda k: F.transform(F.col(f"_{k}"), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), F.lit(f"<{k.upper()}>").alias("tag")))
    d = d.select("_doc", F.col("_doc.text").alias("_text"), F.sort_array(F.concat(*[tagged(k) for k in (*KINDS, "context")])).alias("_spans"))
    d = d.withColumn("_new", F.when(F.size("_spans") > 0, replaced(F.col("_text"), F.col("_spans"))).otherwise(F.col("_text")))
    return d.select(*[F.col("_new").alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in names])
