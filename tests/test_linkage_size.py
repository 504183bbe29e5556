"""Linkage where many rows have equal values: every pair is there, and values are scored once, not once for each pair of rows."""

import re
from itertools import combinations

from goldvein.operators import link


def contacts(spark, rows):
    return link.prepared(spark.createDataFrame(rows, "row long, n string, e string, p string"), "row", "n", "e", "p")


def copies():
    """700 rows of one contact (three units), 30 that share its e-mail and phone under another name, 20 with the e-mail
    only, 9 blank ones; row 5 is there twice, once as another contact."""
    one, other, half = ("ann", "a@x.com", "+971501234567"), ("bob", "a@x.com", "0501234567"), ("ann", "a@x.com", "")
    rows = [(i, *one) for i in range(700)] + [(i, *other) for i in range(700, 730)] + [(i, *half) for i in range(730, 750)] + [(i, "", "", "") for i in range(750, 759)]
    return [*rows, (5, *one), (5, *other)]


def test_dedup_within_copies(spark):
    c = contacts(spark, copies())
    assert link.class_links(c, None, 0.85, names=False).count() == 3
    got = [tuple(r) for r in link.dedup_within(c, 0.85, names=False).select("row_a", "row_b").collect()]
    full = [(i, "x") for i in range(700)] + [(i, "y") for i in range(700, 730)] + [(5, "y")]
    assert sorted(got) == sorted((min(a, b), max(a, b)) for (a, _), (b, _) in combinations(full, 2) if a != b)


def test_link_across_copies(spark):
    """A row id that is null, and ids that both sides have, stay; blank rows meet nobody."""
    a, b = contacts(spark, [*copies(), (None, "ann", "a@x.com", "")]), contacts(spark, [(1, "x", "a@x.com", ""), (2, "x", "a@x.com", ""), (3, "", "", "")])
    got = [tuple(r) for r in link.link_across(a, b, 0.5, names=False).select("row_a", "row_b", "probability").collect()]
    ids = [*range(750), 5, None]
    key = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    assert sorted(got, key=key) == sorted([(i, j, 0.55) for i in ids for j in (1, 2)], key=key)
    plan = link.link_across(a, b, 0.5, names=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" in plan, "values, not rows, are to be joined"


def test_top_within_copies(spark):
    """The report's head is that of all pairs, and comes without them."""
    c = contacts(spark, [*copies(), (751, "cy", "c@x.com", "+971507654321"), (752, "cy", "c@x.com", "+971507654321"), (751, "ann", "", "+971507654321")])
    for threshold, names, most in ((0.85, False, 500), (0.85, False, 1), (0.7, True, 999), (0.5, False, 300_000)):
        want = link.top(link.dedup_within(c, threshold, names=names), most)
        assert [tuple(r) for r in link.top_within(c, threshold, names=names, most=most).collect()] == [tuple(r) for r in want.collect()]
    many = contacts(spark, [(i, "", "a@x.com", "+971501234567") for i in range(200_000)])
    got = [(r.row_a, r.row_b) for r in link.top_within(many, 0.85, names=False).collect()]
    assert got == [(0, i) for i in range(1, 501)]


def test_dedupe_copies(spark, monkeypatch):
    """Clusters and pairs are those of scoring every two rows; no two rows of a class of copies are scored."""
    from pyspark.sql import functions as F

    from goldvein.operators import graph

    values = [("ann lee", "ann@x.com", "1"), ("ann leigh", "ann@x.com", "1"), ("bob", "bob@x.com", "1"), (None, "ann@x.com", "1"), ("zoe", None, "2"), ("ann lee", "ann@x.com", "2"), ("carl", "c@x.com", None)]
    rows = [(i, *values[i % 97 % 7]) for i in range(2000)] + [(None, *values[0]), (3, *values[5])]
    df = spark.createDataFrame(rows, "row long, full_name string, email string, phone string")
    columns, u = ["full_name", "email", "phone"], {"full_name": [0.2, 0.01, 0.01, 0.1, 0.68], "email": [0.3, 0.01, 0.01, 0.1, 0.58], "phone": [0.5, 0.5]}
    strict = df.filter("full_name is not null and email is not null").groupBy("full_name", "email").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]
    prior = link.prior_share(strict, 2002 * 2001 / 2, 0.7)
    seen, real = [], link.probability
    monkeypatch.setattr(link, "probability", lambda pairs, *rest: (seen.append(pairs.count()), real(pairs, *rest))[1])
    for threshold in (0.3, 0.6, 0.85):
        want = real(link.blocked(df, None, "row", "phone", columns), columns, u, prior).filter(F.col("match_probability") >= threshold)
        pairs, groups = link.dedupe(df, "row", columns, "phone", threshold, u=u)
        of = {r.id: r.component for r in graph.components(df.select(F.col("row").alias("id")), want.selectExpr("row_a as a", "row_b as b")).collect()}
        assert {r.id: r.component for r in groups.collect()} == of
        assert pairs.columns == want.columns and pairs.exceptAll(want).isEmpty() and want.exceptAll(pairs).isEmpty() and not want.isEmpty()
    assert max(seen) <= 50


def test_link_names_copies(spark):
    """Names weigh too: each pair of classes by what its values score, blank blocks pruned."""
    a, b = contacts(spark, copies()), contacts(spark, [(i, "ann", "a@x.com", "") for i in range(300)])
    got = link.link_across(a, b, 0.7, prune_blank_blocks=True)
    counts = {tuple(r) for r in got.groupBy("probability", "signals").count().collect()}
    assert counts == {(1.0, 2, 720 * 300)}
    want = link.scored(link.sharing(a, b, 0.7, prune_blank_blocks=True), 0.7)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert "collect_set" in got._jdf.queryExecution().optimizedPlan().toString(), "values, not rows, are to be scored"


def test_pairs_are_not_held(spark):
    """Generated code ends between the two loops, else it holds all pairs of two units before it hands one on."""
    ids = [*range(600), None]
    a, b = contacts(spark, [(i, "ann", "a@x.com", "") for i in ids]), contacts(spark, [(i, "Ann", "A@x.com", "") for i in range(300)])
    for got, want in ((link.link_across(a, b, 0.7), {(i, j) for i in ids for j in range(300)}), (link.dedup_within(a, 0.7), set(combinations(range(600), 2)))):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert re.findall(r"Generate explode|Coalesce|Exchange", plan)[:4] == ["Generate explode", "Coalesce", "Generate explode", "Exchange"]
        pairs = [(r.row_a, r.row_b) for r in got.collect()]
        assert len(pairs) == len(want) and set(pairs) == want


def test_resolve_copies(spark):
    """Within one table and across two, also where a name alone is enough (threshold 0.5)."""
    frame = lambda rows: spark.createDataFrame(rows, "row long, full_name string, email string, phone string")
    a, b = frame([r for r in copies() if r[0] % 4 < 2 or r[0] >= 720]), frame([(i, "Ann", "A@x.com", None) for i in range(300)])
    for other, threshold in ((None, 0.7), (b, 0.7), (None, 0.5), (b, 0.5)):
        got = link.resolve_entities(a, other, "row", threshold)[0]
        x, y = (None if d is None else link.prepared(d, "row", "full_name", "email", "phone") for d in (a, other))
        want = link.scored(link.sharing(x, y, threshold), threshold)
        key = lambda d: sorted(map(tuple, d.collect()))
        assert key(got) == sorted(set(key(want))) and got.count() > 10_000
        assert "collect_set" in got._jdf.queryExecution().optimizedPlan().toString(), "values, not rows, are to be scored"


def test_summary_within_copies(spark):
    """Counts are those of all pairs, and come without them."""
    c = contacts(spark, [*copies(), (None, "ann", "a@x.com", ""), (760, "cy", "c@x.com", "+971507654321")])
    for threshold, names in ((0.85, False), (0.7, True), (0.5, False), (0.5, True)):
        want = link.summary(link.dedup_within(c, threshold, names=names))
        assert sorted(map(tuple, link.summary_within(c, threshold, names=names).collect())) == sorted(map(tuple, want.collect()))
    many = contacts(spark, [(i, "", "a@x.com", "+971501234567") for i in range(200_000)])
    assert [tuple(r) for r in link.summary_within(many, 0.85, names=False).collect()] == [("high", 200_000 * 199_999 // 2)]
