"""String similarities from their published definitions, as Arrow functions over pairs of columns.

Spark has no Indel, partial, token-set or Jaro-Winkler measure. Callers score distinct pairs only, after all native
filters. Values are 0 to 100 (Jaro-Winkler 0 to 1); a null on either side gives null."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

HITS = ArrayType(StructType().add("x", StringType()).add("y", StringType()).add("score", DoubleType()))


def masks(a: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


def lcs(a: str, b: str, of_a: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, by bit-parallel addition."""
    if not a or not b:
        return 0
    of_a, ones = of_a if of_a is not None else masks(a), (1 << len(a)) - 1
    row = ones
    for c in b:
        hit = row & of_a.get(c, 0)
        row = ((row + hit) | (row - hit)) & ones
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a: str, b: str) -> float:
    """The best Indel ratio of the shorter string against the windows, prefixes and suffixes of the longer one."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    of_a, n, best = masks(a), len(a), 0.0
    spans = [(0, k) for k in range(1, n)] + [(i, i + n) for i in range(len(b) - n + 1)] + [(i, len(b)) for i in range(len(b) - n + 1, len(b))]
    for s, e in spans:
        best = max(best, 200.0 * lcs(a, b[s:e], of_a) / (n + e - s))
    if len(a) == len(b):
        of_b = masks(b)
        for k in range(1, n):
            for part in (a[:k], a[k:]):
                best = max(best, 200.0 * lcs(b, part, of_b) / (n + len(part)))
    return best


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    s, gap = len(both), 1 if both else 0
    la, lb = s + gap + len(left), s + gap + len(right)
    best = 100.0 * (1 - (len(left) + len(right) - 2 * lcs(left, right)) / (la + lb))
    if both:
        best = max(best, 100.0 * (1 - (gap + len(left)) / (s + la)), 100.0 * (1 - (gap + len(right)) / (s + lb)))
    return best


def partial_token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    return 100.0 if x & y else partial(" ".join(sorted(x)), " ".join(sorted(y)))


def weighted(a: str, b: str) -> float:
    """The weighted ratio: whole and token measures for similar lengths, partial ones (scaled) for different lengths."""
    if not a or not b:
        return 0.0
    r = max(len(a), len(b)) / min(len(a), len(b))
    if r < 1.5:
        return max(indel(a, b), 0.95 * max(token_sort(a, b), token_set(a, b)))
    p = 0.9 if r <= 8 else 0.6
    sort = partial(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    return max(indel(a, b), p * partial(a, b), 0.95 * p * max(sort, partial_token_set(a, b)))


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    there = [c for c, t in zip(b, taken) if t]
    m, swaps = len(hits), sum(x != y for x, y in zip(hits, there)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


# Lists of texts: what characters and tokens two texts have in common bounds each measure from above. The bounds of all
# pairs are computed at once; only pairs that can reach the cutoff are measured, and these exactly.

SLACK = 1e-6


def bags(texts: list[str]) -> np.ndarray:
    """How often each text has each character; characters are told apart by 6 bits, which can only raise a bound."""
    out = np.zeros((64, len(texts)), np.int32)
    for i, t in enumerate(texts):
        for c in t:
            out[ord(c) & 63, i] += 1
    return out.astype(np.uint8 if out.max(initial=0) < 256 else np.int32)


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For all pairs, the characters in common: no subsequence in common is longer."""
    out = np.zeros((x.shape[1], y.shape[1]), np.int32)
    for a, b in zip(x, y):
        if a.any() and b.any():
            out += np.minimum(a[:, None], b[None, :])
    return out


def alike(xs: list[str], ys: list[str], threshold: float):
    """(i, j, Indel ratio) of all pairs from ``threshold`` on."""
    lengths = np.add.outer([len(x) for x in xs], [len(y) for y in ys])
    can = 200.0 * common(bags(xs), bags(ys)) >= (threshold - SLACK) * lengths
    for i in np.flatnonzero(can.any(1)):
        x, of_x = xs[i], masks(xs[i])
        for j in np.flatnonzero(can[i]):
            n = len(x) + len(ys[j])
            score = 200.0 * lcs(x, ys[j], of_x) / n if n else 100.0
            if score >= threshold:
                yield int(i), int(j), score


def weighted_bound(xs: list[str], ys: list[str]) -> np.ndarray:
    """An upper bound of ``weighted`` for all pairs."""
    forms = (lambda t: t, lambda t: " ".join(sorted(t.split())), lambda t: " ".join(sorted(set(t.split()))))
    size, met = [], []
    last = None
    for f in forms:
        a, b = [f(x) for x in xs], [f(y) for y in ys]
        if (a, b) != last:
            of = common(bags(a), bags(b)).astype(float)
            lengths = np.array([len(t) for t in a], float)[:, None], np.array([len(t) for t in b], float)[None, :]
        last = a, b
        met.append(of)
        size.append(lengths)
    whole = [200 * m / np.maximum(u + v, 1) for m, (u, v) in zip(met, size)]
    part = [200 * m / np.maximum(np.minimum(u, v) + m, 1) for m, (u, v) in zip(met, size)]
    shared = np.zeros(met[0].shape)  # length of the tokens in common, each with a blank
    places: dict[str, list[int]] = {}
    for j, y in enumerate(ys):
        for t in set(y.split()):
            places.setdefault(t, []).append(j)
    holders: dict[str, list[int]] = {}
    for i, x in enumerate(xs):
        for t in set(x.split()) & places.keys():
            holders.setdefault(t, []).append(i)
    for t, rows in holders.items():
        shared[np.ix_(rows, places[t])] += len(t) + 1
    s, (u, v) = np.maximum(shared - 1, 0), size[2]
    tokens = np.maximum(whole[2], 200 * s / np.maximum(s + np.minimum(u, v), 1))
    u, v = size[0]
    r = np.maximum(u, v) / np.maximum(np.minimum(u, v), 1)
    p = np.where(r <= 8, 0.9, 0.6)
    near = np.maximum(whole[0], 0.95 * np.maximum(whole[1], tokens))
    far = np.maximum(whole[0], p * np.maximum(part[0], 0.95 * np.maximum(np.maximum(part[1], part[2]), np.where(s > 0, 100.0, 0))))
    return np.where(r < 1.5, near, far)


def best_weighted(xs: list[str], ys: list[str], cutoff: float):
    """(i, j, weighted ratio): for each x the best y from ``cutoff`` on, of equal ones the smallest."""
    bound = weighted_bound(xs, ys) + SLACK
    for i in np.flatnonzero((bound >= cutoff).any(1)):
        best, at = cutoff, None
        for j in sorted(np.flatnonzero(bound[i] >= cutoff), key=lambda j: -bound[i, j]):
            if bound[i, j] < best:
                break
            score = weighted(xs[i], ys[j])
            if score > best or score == best and (at is None or ys[j] < ys[at]):
                best, at = score, j
        if at is not None:
            yield int(i), int(at), best


def list_function(measure):
    """Hits (x, y, score) of ``measure`` over two columns of text lists."""

    @F.pandas_udf(HITS)
    def score(a: pd.Series, b: pd.Series, cutoff: pd.Series) -> pd.Series:
        return pd.Series([[{"x": x[i], "y": y[j], "score": s} for i, j, s in measure(list(x), list(y), c)] for x, y, c in zip(a, b, cutoff)], dtype="object")

    return score


def arrow_function(measure):
    @F.pandas_udf(DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else measure(x, y) for x, y in zip(a, b)], dtype="float64")

    return score


@F.pandas_udf(DoubleType())
def best_token_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Best of Indel and partial ratio over all pairs of the two token arrays; null if either is empty."""
    return pd.Series([max((max(indel(x, y), partial(x, y)) for x in p for y in q), default=None) if p is not None and q is not None else None for p, q in zip(a, b)], dtype="float64")


indel_ratio = arrow_function(indel)
partial_ratio = arrow_function(partial)
token_set_ratio = arrow_function(token_set)
weighted_ratio = arrow_function(weighted)
jaro_winkler_similarity = arrow_function(jaro_winkler)
alike_in_lists = list_function(alike)
best_weighted_in_lists = list_function(best_weighted)


def lists(texts: DataFrame, column: str, most: int = 512) -> DataFrame:
    """(n, part, texts): distinct texts by length, in lists of about ``most``, dealt by hash."""
    t = texts.select(F.col(column).alias("_t"), F.length(column).alias("n"))
    sizes = t.groupBy("n").agg(F.ceil(F.count("*") / most).alias("_parts"))
    return t.join(sizes, "n").groupBy("n", F.expr("pmod(xxhash64(_t), _parts)").alias("part")).agg(F.collect_list("_t").alias("texts"))
