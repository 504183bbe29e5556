"""Measures over lists: bounds lose no pair, and few pairs are measured."""

import random

from goldvein.functions import similarity
from goldvein.operators import link


def words(n, seed):
    draw = random.Random(seed)
    token = lambda: "".join(draw.choice("abcdé#0189") for _ in range(draw.randint(1, 6)))
    return sorted({draw.choice(["", " ", "  "]).join(["", ""]) + draw.choice([" ", "  ", "\t"]).join(draw.choice(["acme", token(), token()]) for _ in range(draw.randint(1, 7))) for _ in range(n)} | {"a", "acme", "acme acme", "x" * 300})


def test_bounds_hold():
    xs, ys = words(150, 1), words(150, 2)
    bound = similarity.weighted_bound(xs, ys)
    assert all(similarity.weighted(x, y) <= bound[i, j] + similarity.SLACK for i, x in enumerate(xs) for j, y in enumerate(ys))
    for cutoff in (60, 80, 95):
        want = {}
        for i, x in enumerate(xs):
            s, y = min((-similarity.weighted(x, y), y) for y in ys)
            if -s >= cutoff:
                want[x] = (y, -s)
        assert {xs[i]: (ys[j], s) for i, j, s in similarity.best_weighted(xs, ys, cutoff)} == want


def test_party_measures_few(spark, monkeypatch):
    xs, ys = [f"Acme {i:09}" for i in range(400)], [f"Acme #{i:09} Ltd" for i in range(400)]
    seen, real = [], similarity.weighted
    monkeypatch.setattr(similarity, "weighted", lambda a, b: (seen.append(1), real(a, b))[1])
    assert [(i, j) for i, j, _ in similarity.best_weighted(xs, ys, 80)] == [(i, i) for i in range(400)]
    assert len(seen) < 400 * 400 / 20
    got = link.best_party(*(spark.createDataFrame([(t,) for t in ts * 2], "name string") for ts in (xs, ys))).collect()
    assert {(r.name, r.party) for r in got} == set(zip(xs, ys)) and len(got) == 400


def test_alike_measures_few(monkeypatch):
    xs = [f"supplier#{i * 37:09} | {i % 25}" for i in range(600)]
    seen, real = [], similarity.lcs
    want = [(i, j, similarity.indel(x, y)) for i, x in enumerate(xs) for j, y in enumerate(xs) if similarity.indel(x, y) >= 95]
    monkeypatch.setattr(similarity, "lcs", lambda *a: (seen.append(1), real(*a))[1])
    assert list(similarity.alike(xs, xs, 95)) == want and len(want) > 600
    assert len(seen) < 600 * 600 / 10


def test_fuzzy_rows_in_many_lists(spark):
    """More texts of one length than a list holds, other lengths, equal texts and nulls: every pair is there once."""
    from goldvein.operators import profile

    texts = [f"N{i * 7 % 1300:05}" for i in range(1300)] + ["N00007x", "n00007", None, "", "N00014"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = sorted(tuple(r) for r in profile.fuzzy_rows(df, "k", ["t"], 80).collect())
    low = [(t or "").lower() for t in texts]
    want = [(a, b, similarity.indel(low[a], low[b])) for a in range(len(low)) for b in range(a + 1, len(low)) if similarity.indel(low[a], low[b]) >= 80]
    assert got == want and len(want) > 1000
    plan = profile.fuzzy_rows(df, "k", ["t"], 80)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan, "lists of texts, not pairs, are to reach Python"
