"""Record linkage: rule-scored pairs, and probabilistic (Fellegi-Sunter) matching with clusters."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity
from . import graph

STRONG, EMAIL, PHONE, CAP, MOST = 0.9, 0.98, 0.97, 0.55, 500
#: what is compared; rows of a class that are paired as one unit
VALUES, UNIT = ["name", "email", "phone"], 256
# Parts of column names that tell a signal, and parts that speak against it.
SIGNALS = {
    "email": (["email", "mail", "e_mail"], ["opt_out", "_at", "_time", "_date", "valid"]),
    "phone": (["phone", "mobile", "tel", "cell"], ["_at", "_time", "_date"]),
    "name": (["full_name", "fullname", "name", "owner_name", "contact", "person"], ["file", "user", "host", "domain", "company"]),
}


def identity_columns(columns: list[str]) -> dict[str, str]:
    """signal -> column. A column serves one signal, an e-mail before a phone before a name; the first of a signal stays,
    but a full name replaces another name."""
    out: dict[str, str] = {}
    for column in columns:
        low = column.lower()
        fits = [s for s, (parts, against) in SIGNALS.items() if any(p in low for p in parts) and not any(p in low for p in against)]
        for s in fits:
            fuller = s == "name" and "full" in low and "full" not in out.get(s, "full").lower()
            if s not in out or fuller:
                out[s] = column
                break
    return out


def prepared(df: DataFrame, index: str, name: str | None, email: str | None, phone: str | None) -> DataFrame:
    """(row, name, email, phone): trimmed lower-case text, absent ones ''."""
    get = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) if c else F.lit("")
    return df.select(F.col(index).alias("row"), get(name).alias("name"), get(email).alias("email"), get(phone).alias("phone"))


def candidates(a: DataFrame, b: DataFrame | None, signals: list[str], prune_blank_blocks: bool = False) -> DataFrame:
    """Pairs that share the first character of a signal: one equi-join per signal, then distinct. Blank values are a
    block of their own unless pruned. With ``b`` None: pairs within ``a``, row_a < row_b."""
    left = a.select(*[F.col(c).alias(f"{c}_a") for c in a.columns])
    right = (b if b is not None else a).select(*[F.col(c).alias(f"{c}_b") for c in a.columns])
    out = None
    for s in signals:
        l, r = left.withColumn("_k", F.substring(f"{s}_a", 1, 1)), right.withColumn("_k", F.substring(f"{s}_b", 1, 1))
        p = l.join(r, "_k").filter("_k <> ''" if prune_blank_blocks else "true").drop("_k")
        p = p.filter("row_a < row_b") if b is None else p
        out = p if out is None else out.unionByName(p)
    return out.distinct()


def phone_match(a: Column, b: Column) -> Column:
    x, y = F.regexp_replace(a, "[^0-9]", ""), F.regexp_replace(b, "[^0-9]", "")
    return (F.length(x) >= 7) & (F.length(y) >= 7) & ((x == y) | (F.right(x, F.lit(9)) == F.right(y, F.lit(9))))


def sharing(a: DataFrame, b: DataFrame | None, threshold: float, names: bool = True, prune_blank_blocks: bool = False, signals: tuple[str, ...] = ("name", "email", "phone")) -> DataFrame:
    """The ``candidates`` over name, email and phone that can reach the threshold. A pair needs a strong signal, and two
    beyond ``CAP``, so equal emails or phones are among them unless a name alone is enough: two equi-joins on whole
    values, not on first characters. With ``b`` None: pairs within ``a``, row_a < row_b."""
    if names and threshold <= CAP:
        return candidates(a, b, list(signals), prune_blank_blocks)
    left = a.distinct().select(*[F.col(c).alias(f"{c}_a") for c in a.columns])
    right = (b if b is not None else a).distinct().select(*[F.col(c).alias(f"{c}_b") for c in a.columns])
    same = (F.col("email_a") == F.col("email_b")) & (F.col("email_a") != "")
    by_email = left.filter("email_a <> ''").join(right, F.col("email_a") == F.col("email_b"))
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    key = lambda d, c: d.withColumn("_k", F.right(digits(c), F.lit(9))).filter(F.length("_k") >= 7)
    by_phone = key(left, "phone_a").join(key(right, "phone_b"), "_k").drop("_k").filter(phone_match(F.col("phone_a"), F.col("phone_b")) & ~same)
    first = lambda s: (F.substring(f"{s}_a", 1, 1) == F.substring(f"{s}_b", 1, 1)) & ((F.col(f"{s}_a") != "") | F.lit(not prune_blank_blocks))
    out = by_email.unionByName(by_phone.filter(reduce(lambda x, y: x | y, map(first, signals))))
    return out.filter("row_a < row_b") if b is None else out


def scored(pairs: DataFrame, threshold: float, names: bool = True) -> DataFrame:
    """row_a, row_b, probability, confidence, signals. One strong signal alone is capped; two or more combine as 1 - the
    product of misses over all signals."""
    email = F.when((F.col("email_a") != "") & (F.col("email_a") == F.col("email_b")), F.lit(EMAIL))
    phone = F.when(phone_match(F.col("phone_a"), F.col("phone_b")), F.lit(PHONE))
    strengths = [email, phone]
    if names:
        # the measure is computed once per distinct pair of names, after the native filters
        tokens = similarity.token_set_ratio("name_a", "name_b")
        texts = pairs.filter("name_a <> '' and name_b <> ''").select("name_a", "name_b").distinct().withColumn("_t", tokens)
        pairs = pairs.join(texts, ["name_a", "name_b"], "left")
        strengths.append(F.when(F.col("_t") >= 90, F.col("_t") / 100).when(F.col("_t") >= 75, 0.6 * F.col("_t") / 100))
    s = F.filter(F.array(*strengths), lambda x: x.isNotNull())
    strong = F.size(F.filter("_s", lambda x: x >= STRONG))
    together = 1 - F.aggregate("_s", F.lit(1.0), lambda p, x: p * (1 - x))
    p = F.when(strong >= 2, together).when(strong == 1, F.least(F.array_max("_s"), F.lit(CAP)))
    out = pairs.withColumn("_s", s).withColumn("probability", F.round(p, 4)).filter(F.col("probability") >= threshold)
    level = F.when(F.col("probability") >= 0.9, "high").when(F.col("probability") >= 0.75, "medium").otherwise("low")
    return out.select("row_a", "row_b", "probability", level.alias("confidence"), F.size("_s").alias("signals"))


def classes(a: DataFrame) -> DataFrame:
    """(key, rows): the distinct row ids of equal name, email and phone. Each id is in a struct, so that a null stays."""
    return a.groupBy(F.struct(*VALUES).alias("key")).agg(F.collect_set(F.struct("row")).alias("rows"))


def class_links(a: DataFrame, b: DataFrame | None, threshold: float, names: bool = True, prune_blank_blocks: bool = False, signals: tuple[str, ...] = ("name", "email", "phone")) -> DataFrame:
    """``scored`` pairs of classes (row_a, row_b are their keys): rows of equal values score alike, so each pair of
    values is scored once, however many rows have them. With ``b`` None: pairs within ``a``, row_a <= row_b."""
    keyed = lambda d: d.select(F.struct(*VALUES).alias("row"), *VALUES).distinct()
    x, y = keyed(a), None if b is None else keyed(b)
    pairs = sharing(x, y, threshold, names, prune_blank_blocks, signals)
    if b is None:
        pairs = pairs.unionByName(x.select(*[F.col(c).alias(f"{c}_{s}") for s in "ab" for c in x.columns]))
    return scored(pairs, threshold, names)


def expanded(links: DataFrame, a: DataFrame, b: DataFrame | None) -> DataFrame:
    """The pairs of rows of ``class_links``. Classes are cut into units of ``UNIT`` rows, and the pairs of units are dealt
    evenly, so no class makes a task long; the pairs within them come from two nested loops, without a join. Spark's
    generated code holds all that comes of one input row before it hands it on. ``coalesce`` to as many partitions as there
    are ends that code between the loops, so a unit's rows are held at a time, not the pairs of two units."""

    def units(d: DataFrame, s: str) -> DataFrame:
        starts = F.sequence(F.lit(1), F.size("rows"), F.lit(UNIT))
        return classes(d).select(F.col("key").alias(f"row_{s}"), F.posexplode(F.transform(starts, lambda i: F.slice("rows", i, UNIT))).alias(f"_u_{s}", f"_rows_{s}"))

    met = links.join(units(a, "a"), "row_a").join(units(a if b is None else b, "b"), "row_b")
    if b is None:
        own = F.col("row_a") == F.col("row_b")
        met = met.filter(~own | (F.col("_u_a") <= F.col("_u_b"))).withColumn("_own", own & (F.col("_u_a") == F.col("_u_b")))
    rest = ["probability", "confidence", "signals"]
    ids = [F.col(f"_rows_{s}.row").alias(f"_rows_{s}") for s in "ab"]
    parts = 4 * a.sparkSession.sparkContext.defaultParallelism
    met = met.select(*ids, *rest, *(["_own"] if b is None else [])).repartition(parts)
    x, y = F.col("_a"), F.col("_b")
    pairs = met.withColumn("_a", F.explode("_rows_a")).drop("_rows_a").coalesce(parts).withColumn("_b", F.explode("_rows_b"))
    if b is None:
        pairs = pairs.filter((x < y) | (~F.col("_own") & (x > y)))
        x, y = F.least(x, y), F.greatest(x, y)
    return pairs.select(x.alias("row_a"), y.alias("row_b"), *rest)


def link_across(a: DataFrame, b: DataFrame, threshold: float = 0.7, prune_blank_blocks: bool = False, names: bool = True) -> DataFrame:
    return expanded(class_links(a, b, threshold, names, prune_blank_blocks), a, b)


def dedup_within(a: DataFrame, threshold: float = 0.85, prune_blank_blocks: bool = False, names: bool = True) -> DataFrame:
    return expanded(class_links(a, None, threshold, names, prune_blank_blocks), a, None)


def resolve_entities(a: DataFrame, b: DataFrame | None, index: str, threshold: float = 0.7) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """(matches, signal -> its columns): across two tables, or within one. Signals that either table lacks are left
    out; without any: ValueError."""
    left, right = identity_columns(a.columns), identity_columns((a if b is None else b).columns)
    both = tuple(s for s in ("name", "email", "phone") if s in left and s in right)
    if not both:
        raise ValueError(f"no identity column in common: {left}, {right}")
    x = prepared(a, index, *[left[s] if s in both else None for s in ("name", "email", "phone")])
    y = None if b is None else prepared(b, index, *[right[s] if s in both else None for s in ("name", "email", "phone")])
    names = "name" in both
    return expanded(class_links(x, y, threshold, names, signals=both), x, y), {s: (left[s], right[s]) for s in both}


def top(matches: DataFrame, most: int = MOST) -> DataFrame:
    """The report's head: best first, ties by rows."""
    return matches.orderBy(F.desc("probability"), "row_a", "row_b").limit(most)


def top_within(a: DataFrame, threshold: float = 0.85, prune_blank_blocks: bool = False, names: bool = True, most: int = MOST) -> DataFrame:
    """``top`` of ``dedup_within``, with only the pairs that it can hold. A lead is a probability and a row with a later
    partner at it. Each lead has a pair, and its pairs come before those of later leads: the first ``most`` leads do."""
    links = class_links(a, None, threshold, names, prune_blank_blocks)
    rest = ["probability", "confidence", "signals"]
    back = links.filter("row_a <> row_b").select(F.col("row_b").alias("row_a"), F.col("row_a").alias("row_b"), *rest)
    rows = a.select(F.struct(*VALUES).alias("key"), "row").distinct()
    last = rows.groupBy(F.col("key").alias("row_b")).agg(F.max("row").alias("_last"))
    leads = links.unionByName(back).join(last, "row_b").join(rows.withColumnsRenamed({"key": "row_a", "row": "_a"}), "row_a").filter("_a < _last")
    first = leads.select("probability", "_a").distinct().orderBy(F.desc("probability"), "_a").limit(most)
    pairs = leads.join(first, ["probability", "_a"]).join(rows.withColumnsRenamed({"key": "row_b", "row": "_b"}), "row_b").filter("_a < _b")
    return top(pairs.select(F.col("_a").alias("row_a"), F.col("_b").alias("row_b"), *rest), most)


def summary(matches: DataFrame) -> DataFrame:
    return matches.groupBy("confidence").agg(F.count("*").alias("matches"))


def summary_within(a: DataFrame, threshold: float = 0.85, prune_blank_blocks: bool = False, names: bool = True) -> DataFrame:
    """``summary`` of ``dedup_within`` from the sizes of classes, without its pairs; a row id that two classes share is
    no pair of its own."""
    rows = a.filter("row is not null").select(F.struct(*VALUES).alias("key"), "row").distinct()
    x, y = (rows.select(F.col("key").alias(f"row_{s}"), "row") for s in "ab")
    n, m = (rows.groupBy(F.col("key").alias(f"row_{s}")).agg(F.count("*").alias(f"_n_{s}")) for s in "ab")
    twice = x.join(y, "row").filter("row_a < row_b").groupBy("row_a", "row_b").agg(F.count("*").alias("_twice"))
    met = class_links(a, None, threshold, names, prune_blank_blocks).join(n, "row_a").join(m, "row_b").join(twice, ["row_a", "row_b"], "left")
    pairs = F.when(F.col("row_a") == F.col("row_b"), F.expr("_n_a * (_n_a - 1) div 2")).otherwise(F.col("_n_a") * F.col("_n_b") - F.coalesce("_twice", F.lit(0)))
    return met.withColumn("_pairs", pairs).filter("_pairs > 0").groupBy("confidence").agg(F.sum("_pairs").alias("matches"))


def best_party(names: DataFrame, parties: DataFrame, cutoff: float = 80) -> DataFrame:
    """name, party, score: the best weighted ratio from ``cutoff`` on; ties go to the smallest party name.

    Lists of names meet lists of parties, as no block by parts of the text holds all pairs at the cutoff. Bounds of all
    pairs come from arrays of counts; a pair is measured where its bound leaves it a chance to be a name's best."""
    n = similarity.lists(names.select("name").filter("trim(name) <> ''").distinct(), "name").select(F.col("texts").alias("_names"))
    p = similarity.lists(parties.select(F.col("name").alias("party")).filter("trim(party) <> ''").distinct(), "party").select(F.col("texts").alias("_parties"))
    met = n.crossJoin(p).repartition(4 * names.sparkSession.sparkContext.defaultParallelism)
    hits = met.select(F.inline(similarity.best_weighted_in_lists("_names", "_parties", F.lit(float(cutoff))))).withColumnsRenamed({"x": "name", "y": "party"})
    return hits.groupBy("name").agg(F.min_by("party", F.struct(-F.col("score"), "party")).alias("party"), F.max("score").alias("score"))


# Fellegi-Sunter -----------------------------------------------------------------------------------------------------

# What is compared and blocked on, by entity; spellings of the compared columns.
BLUEPRINTS = {
    "Customers": (["full_name", "email", "phone", "country"], "country"), "Employees": (["full_name", "email", "phone", "department_code"], "country"), "Vendors": (["vendor_name", "contact_email", "contact_phone"], "country"),
    "Invoices": (["invoice_no", "customer_id", "amount"], "customer_id"), "Products": (["product_name", "sku", "category"], "category"),
}
SPELLINGS = {
    "employee_id": ["emp_no", "emp_id", "employee_id"], "full_name": ["full_nm", "full_name", "emp_full_name", "contact_nm", "customer_name"], "email": ["work_email", "email_addr", "email"], "phone": ["mobile_nr", "phone_nr", "phone"],
    "department_code": ["dept_cd", "dept", "department_code"], "country": ["ctry", "country", "location"], "customer_id": ["customer_id", "cust_id", "cust_key"],
}
BLOCKS = ["department_code", "country", "status"]
#: share of true matches at each level, highest level first: parameters, as no labels exist to train them
M = {"exact": [0.9, 0.1], "name": [0.80, 0.08, 0.05, 0.04, 0.03], "email": [0.80, 0.08, 0.05, 0.04, 0.03]}


def kind_of(column: str) -> str:
    return "name" if column.endswith("name") else "email" if column.endswith("email") else "exact"


def level(kind: str, a: Column, b: Column) -> Column:
    """0 is the best level; null where a side is missing."""
    eq = a == b
    if kind == "exact":
        n = F.when(eq, 0).otherwise(1)
    elif kind == "name":
        jw = similarity.jaro_winkler_similarity(a, b)
        n = F.when(eq, 0).when(jw >= 0.92, 1).when(jw >= 0.88, 2).when(jw >= 0.70, 3).otherwise(4)
    else:
        x, y = F.element_at(F.split(a, "@"), 1), F.element_at(F.split(b, "@"), 1)
        n = F.when(eq, 0).when(x == y, 1).when(similarity.jaro_winkler_similarity(a, b) >= 0.88, 2).when(similarity.jaro_winkler_similarity(x, y) >= 0.88, 3).otherwise(4)
    return F.when(a.isNotNull() & b.isNotNull(), n)


def canonical(df: DataFrame) -> DataFrame:
    """Known spellings to the compared names; the first of two that meet is kept."""
    of = {s: c for c, ss in SPELLINGS.items() for s in ss}
    chosen: dict[str, str] = {}
    for c in df.columns:
        chosen.setdefault(of.get(c.lower(), c), c)
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in chosen.items()])


def u_shares(df: DataFrame, columns: list[str], index: str, salts: int = 4, buckets: int | None = None) -> dict[str, list[float]]:
    """Share of unrelated pairs at each level. Rows meet in random buckets: a sample of all pairs whose size follows
    the rows (about ``salts`` * 64 pairs each), which is what the share needs; exact columns use value frequencies. Pairs are counted by their values, so a pair of values is
    compared once."""
    n = df.count()
    out = {}
    for c in columns:
        if kind_of(c) == "exact":
            f = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("same"), F.sum("k").alias("n")).first()
            pairs = (f.n or 0) * ((f.n or 0) - 1)
            same = (f.same or 0) / pairs if pairs else 0.0
            out[c] = [max(same, 1e-9), max(1 - same, 1e-9)]
    rest = [c for c in columns if c not in out]
    if rest:
        parts = buckets or max(1, n // 64)
        salted = df.select(index, *rest, F.explode(F.sequence(F.lit(1), F.lit(salts))).alias("_salt")).withColumn("_b", F.pmod(F.xxhash64(index, "_salt"), F.lit(parts)))
        a, b = (salted.select(*[F.col(c).alias(f"{c}_{s}") for c in (index, *rest)], "_salt", "_b") for s in "ab")
        pairs = a.join(b, ["_salt", "_b"]).filter(F.col(f"{index}_a") < F.col(f"{index}_b"))
        for c in rest:
            x, y = F.col(f"{c}_a"), F.col(f"{c}_b")
            met = pairs.filter(x.isNotNull() & y.isNotNull()).groupBy(x, y).agg(F.count("*").alias("n"))
            got = {r["l"]: r["n"] for r in met.select(level(kind_of(c), x, y).alias("l"), "n").groupBy("l").agg(F.sum("n").alias("n")).collect()}
            total = sum(got.values()) or 1
            out[c] = [max(got.get(i, 0) / total, 1e-6) for i in range(len(M[kind_of(c)]))]
    return out


def probability(pairs: DataFrame, columns: list[str], u: dict[str, list[float]], prior: float) -> DataFrame:
    """``pairs`` (x_a, x_b columns) with match_weight (log2) and match_probability; missing values weigh nothing."""
    weights, total = [], F.lit(math.log2(prior / (1 - prior)))
    for c in columns:
        kind = kind_of(c)
        pairs = pairs.withColumn(f"_l_{c}", level(kind, F.col(f"{c}_a"), F.col(f"{c}_b")))
        table = F.array(*[F.lit(math.log2(m / x)) for m, x in zip(M[kind], u[c])])
        weights.append(F.coalesce(F.get(table, F.col(f"_l_{c}")), F.lit(0.0)))
    total = reduce(lambda a, b: a + b, weights, total)
    bayes = F.pow(F.lit(2.0), F.least(F.col("match_weight"), F.lit(500.0)))
    return pairs.withColumn("match_weight", total).withColumn("match_probability", bayes / (1 + bayes)).drop(*[f"_l_{c}" for c in columns])


def prior_share(rule_pairs: int, all_pairs: float, recall: float) -> float:
    """Share of matches among all pairs, from the pairs that a strict rule finds and its recall; kept inside (0, 1)."""
    return min(max(rule_pairs / recall / max(all_pairs, 1.0), 1e-9), 1 - 1e-9)


def blocked(a: DataFrame, b: DataFrame | None, index: str, block: str, columns: list[str], other: str | None = None) -> DataFrame:
    """Pairs that agree on ``block``. With ``b`` None: within ``a``, ``index`` of the one below ``other`` (``index``) of the second."""
    cols = list(dict.fromkeys([index, *columns]))
    l = a.select(F.col(block).alias("_k"), *[F.col(c).alias(f"{c}_a") for c in cols])
    r = (b if b is not None else a).select(F.col(block).alias("_k"), *[F.col(c).alias(f"{c}_b") for c in cols])
    p = l.join(r, "_k").drop("_k")
    return p.filter(F.col(f"{index}_a") < F.col(f"{other or index}_b")) if b is None else p


def dedupe(df: DataFrame, index: str, columns: list[str], block: str, threshold: float = 0.95, recall: float = 0.7, u=None) -> tuple[DataFrame, DataFrame]:
    """(scored pairs from ``threshold`` on, (id, component) of all rows)."""
    u = u or u_shares(df, columns, index)
    n = df.count()
    strict = df.filter(F.col(columns[0]).isNotNull() & F.col(columns[1]).isNotNull()).groupBy(columns[0], columns[1]).agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()[0] or 0
    # rows of equal values are one class; a pair of classes stands for its rows a < b, of which there is one if _min_a < _max_b
    cols = list(dict.fromkeys([block, *columns]))
    rows = df.select(F.struct(*cols).alias("_key"), F.col(index).alias("_row")).filter("_row is not null")
    sets = rows.groupBy("_key").agg(F.min("_row").alias("_min"), F.max("_row").alias("_max")).select("*", *[F.col(f"_key.{c}").alias(c) for c in cols])
    met = blocked(sets, None, "_min", block, ["_key", "_max", *columns], "_max")
    links = graph.kept(probability(met, columns, u, prior_share(strict, n * (n - 1) / 2, recall)).filter(F.col("match_probability") >= threshold))
    a, b = (rows.select(F.col("_key").alias(f"_key_{s}"), F.col("_row").alias(f"{index}_{s}")) for s in "ab")
    own = [f"{c}_{s}" for s in "ab" for c in dict.fromkeys([index, *columns])]
    bare = links.drop(f"{index}_a", f"{index}_b")
    pairs = bare.join(a, "_key_a").join(b, "_key_b").filter(F.col(f"{index}_a") < F.col(f"{index}_b")).select(*own, "match_weight", "match_probability")
    # any pair a < b of two classes is joined by a - max(b) - min(a) - b, each of which is a pair too
    up = a.join(bare, "_key_a").select(F.col(f"{index}_a").alias("a"), F.col("_max_b").alias("b"))
    down = b.join(bare, "_key_b").select(F.col("_min_a").alias("a"), F.col(f"{index}_b").alias("b"))
    return pairs, graph.components(df.select(F.col(index).alias("id")), up.unionByName(down).filter("a < b"))


def fuzzy_duplicates(master: DataFrame, entity: str, index: str, threshold: float = 0.95, u=None) -> DataFrame:
    """(cluster, id, size) of a master table's active rows in clusters of two and more: flagged for review, not merged.
    An entity without a blueprint: ValueError."""
    if entity not in BLUEPRINTS:
        raise ValueError(f"no blueprint for {entity!r}")
    columns, block = BLUEPRINTS[entity]
    rows = master.filter(F.col("archived_at").isNull()) if "archived_at" in master.columns else master
    found = dedupe(rows, index, [c for c in columns if c in rows.columns], block if block in rows.columns else rows.columns[0], threshold, u=u)[1]
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1")
    return found.join(sizes, "component").select(F.col("component").alias("cluster"), "id", "size")


def match_queue(staged: dict[str, DataFrame], entity: str, index: str, threshold: float = 0.5, u=None) -> tuple[list[str], DataFrame | None]:
    """(the first two staging tables of the entity by name, their pairs): None if there are fewer than two."""
    names = sorted(n for n in staged if n.startswith(f"stg_{entity.lower()}__"))[:2]
    return names, link_tables(staged[names[0]], staged[names[1]], index, entity, threshold, u=u) if len(names) == 2 else None


def link_tables(a: DataFrame, b: DataFrame, index: str, entity: str, threshold: float = 0.9, recall: float = 0.9, u=None) -> DataFrame:
    """Pairs of two tables on their common compared columns; needs two of them, else ValueError."""
    a, b = canonical(a), canonical(b)
    both = [c for c in a.columns if c in b.columns]
    columns = [c for c in BLUEPRINTS[entity][0] if c in both]
    columns += [c for c in ("employee_id", "customer_id", "country") if c in both and c not in columns]
    if len(columns) < 2:
        raise ValueError(f"not enough common columns: {columns}")
    block = next((c for c in BLOCKS if c in both), None) or next(c for c in both if not c.startswith("_") and c != index)
    if u is None:
        shared = a.select(*both).unionByName(b.select(*both))
        u = u_shares(shared.withColumn(index, F.xxhash64(*both)), columns, index)
    n, m = a.count(), b.count()
    strict = a.select(*[F.col(c) for c in columns[:2]]).join(b.select(*columns[:2]), columns[:2]).count()
    return probability(blocked(a, b, index, block, columns), columns, u, prior_share(strict, n * m, recall)).filter(F.col("match_probability") >= threshold)


def decisions(old: DataFrame | None, spark, entity: str, a: str, b: str, p: float, decision: str) -> DataFrame:
    """The steward's decisions with one more; approve or reject, else ValueError."""
    if decision not in ("approve", "reject"):
        raise ValueError(decision)
    row = spark.createDataFrame([(entity, a, b, p, decision)], "entity string, pair_a string, pair_b string, probability double, decision string")
    return row if old is None else old.unionByName(row)
