"""Secret scans (operator 7): fixed patterns, and character Markov models.

Base kinds are found leftmost and non-overlapping by their patterns. The method adds kind ``markov``: runs of
``LEAST_LENGTH`` and more characters of ``[A-Za-z0-9+/_=-]`` whose mean log-likelihood ratio per character between a
first-order Markov model of random strings and one of ordinary identifiers exceeds ``MARGIN``. Of a run that meets base
spans, the parts outside them are scored each; a part shorter than ``LEAST_LENGTH`` needs the summed ratio that the
shortest whole run needs.

Training. The labelled samples come from the documents themselves: values of base matches (label: random) and whole
words of letters, numbered and in snake_case, camelCase, acronym and path compounds (label: ordinary), beside rules of
signs and dates, from the ``SAMPLE_DOCS`` rows with the smallest hash of the id: a bounded, documented sample. As a corpus may
hold few secrets, ``DRAWN`` random strings over the usual alphabets, drawn from a fixed seed, join the random side.
Only the models (transition counts over a fixed alphabet) are sent to executors.

Null text: an empty one, no spans. Empty table: no rows. Repeated rows: each has its result. Texts go whole; all
patterns take time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

KINDS = ("assign", "access", "hex", "markov")
SAMPLE_DOCS, SAMPLE_WORDS, DRAWN, SEED = 2_000, 50_000, 4_000, 7
LEAST_LENGTH, MARGIN, BACK_OFF = 16, 1.45, 10
#: longer strings are no training samples, so what leaves the executors is bounded in bytes too
LONGEST_SAMPLE = 256
ALPHABET = "^$abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile(
    "(?:" + "|".join(map(either, ("password", "passwd", "secret", "token", "api"))).replace(either("api"), either("api") + "_?" + either("key"))
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}")
WORD = re.compile(r"(?<!\S)[A-Za-z][a-z]{1,14}(?=[.,;:!?]*(?:\s|$))")
#: Words that any corpus may use in identifiers, so that a small one has ordinary strings too.
ORDINARY = "the of and to in is for with on by value name index type list item count size user file path data key time date page text line node table column row state error message result config manager service request response handler factory builder".split()
KEYWORD = re.compile("password|passwd|secret|token|api")


def assigns(text: str) -> list[tuple[int, int, str]]:
    """(start, end, value) of all assign matches, failing ones included."""
    if not KEYWORD.search(text.lower()):
        return []
    return [(m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", a, b) for a, b, value in assigns(text) if len(value) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def counted(strings) -> Counter:
    pairs: Counter = Counter()
    for s in strings:
        s = f"^{s}$"
        pairs.update(zip(s, s[1:]))
    return pairs


def logs(pairs: Counter) -> dict:
    """Transition -> log probability, backed off to single characters where a context is rare."""
    from_, single = Counter(), Counter()
    for (a, b), n in pairs.items():
        from_[a] += n
        single[b] += n
    whole = sum(single.values()) + 0.5 * len(ALPHABET)
    alone = {b: (single[b] + 0.5) / whole for b in ALPHABET}
    return {(a, b): math.log((pairs[a, b] + BACK_OFF * alone[b]) / (from_[a] + BACK_OFF)) for a in ALPHABET for b in ALPHABET}


def drawn() -> list[str]:
    rng = random.Random(SEED)
    low, up, digits = ALPHABET[2:28], ALPHABET[28:54], ALPHABET[54:64]
    kinds = (digits + "abcdef", low + digits, up + digits, low + up + digits, low + up + digits + "+/", low + up + digits + "-_")
    return ["".join(rng.choices(kinds[i % len(kinds)], k=rng.randint(16, 48))) for i in range(DRAWN)]


def compounds(words: list[str]) -> list[str]:
    """Ordinary identifiers made of words: alone, numbered, and joined in the usual ways."""
    out = []
    for i, w in enumerate(words):
        a, b = words[i - 1], words[i - 2]
        out += [w, f"{w}{i % 100}", f"{a}_{w}", f"{a}-{w}-{b}", a + w.capitalize() + b.capitalize(), f"{a.upper()}_{w.upper()}", f"{a}/{w}/{b}_{i % 1000}"]
        out += [a.upper()[:4] + w.capitalize() + b.upper()[:3], f"{a.capitalize()}-{w.capitalize()}", f"/{a}/{w}-{b}/", f"//{a}/{w}", f"{a}={w}", f"{a}+{w}"]
    return out


def plain() -> list[str]:
    """Ordinary runs without words: rules of one or two signs, dates and times."""
    signs = "-=_+/"
    out = [(a + b) * n for a in signs for b in signs for n in (8, 20, 40)] + [f"{a}{b * 20}" * 3 + a for a in signs for b in signs]
    return out + [f"20{i % 30:02}{s}{i % 12 + 1:02}{s}{i % 28 + 1:02}{s}{i % 24:02}{s}{i * 7 % 60:02}{s}{i * 11 % 60:02}" for i in range(100) for s in "-/_"]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict:
    """transition -> log-likelihood ratio (random over ordinary), from the bounded labelled sample."""
    # the bound is found on hashes alone, so that no task gathers texts from all the others
    key = F.xxhash64("doc_id")
    top = docs.select(key.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    sample = only(docs, "doc_id", "text").filter((key <= F.lit(top)) & F.col("text").isNotNull()).orderBy(key, F.xxhash64("text")).limit(sample_docs)
    # only words and matched values leave the executors: at most SAMPLE_WORDS of each label, of LONGEST_SAMPLE characters

    def labelled(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                spans = base_spans(text)
                rows += [(1, text[s:e]) for k, s, e in spans if k != "assign"]
                rows += [(1, v) for _, _, v in assigns(text) if len(v) >= 12]
                rows += [(0, w) for w in set(WORD.findall(text))]
            rows = [r for r in rows if len(r[1]) <= LONGEST_SAMPLE]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows])], ["label", "s"])

    rows = sample.mapInArrow(labelled, "label int, s string").distinct()
    found = {k: [r.s for r in rows.filter(F.col("label") == k).orderBy(F.xxhash64("s"), "s").limit(SAMPLE_WORDS).collect()] for k in (0, 1)}
    return model(found[1], found[0])


def model(secrets: list[str], words: list[str]) -> dict:
    noise, usual = logs(counted([*secrets, *drawn()])), logs(counted([*compounds([*ORDINARY, *words]), *plain() * (1 + len(words) // 500)]))
    return {k: noise[k] - usual[k] for k in noise}


def suspicious(s: str, llr: dict) -> bool:
    """The mean ratio per transition exceeds the margin; a short part of a run is held against the shortest run's sum."""
    framed = f"^{s}$"
    return sum(map(llr.__getitem__, zip(framed, framed[1:]))) > MARGIN * (max(len(s), LEAST_LENGTH) + 1)


def covered(spans: list[tuple[str, int, int]]) -> list[list[int]]:
    """The stretches that some span covers, in order."""
    out: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda x: x[1:]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def markov_spans(text: str, base: list[tuple[str, int, int]], llr: dict) -> list[tuple[str, int, int]]:
    """Of each run what the base spans leave, if it is suspicious; one pass over runs and spans."""
    out, taken, i = [], covered(base), 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        k = i
        while start < end:
            a, b = taken[k] if k < len(taken) else (end, end)
            if start < min(a, end) and suspicious(text[start : min(a, end)], llr):
                out.append(("markov", start, min(a, end)))
            start, k = max(start, b) if a < end else end, k + 1
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


def scan(docs: DataFrame, llr: dict | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(llr or train(docs))

    def run(batches):
        import pyarrow as pa

        weights = shared.value
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                more = markov_spans(text or "", base, weights)
                n = Counter(k for k, _, _ in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            kinds = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_markov", pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], ["doc_id", *[n for n, _ in kinds]])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"
    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, schema)
