"""Benchmark decontamination by canonical templates (operator 1).

Each text becomes a row of template tokens (see ``tokens``): a white-space chunk in lower case without outer punctuation,
where numbers, units after numbers, and names (capitalised words inside a sentence) give way to the typed placeholders
<num>, <unit> and <name>, whose values are the slots. A capitalised word at a sentence's start may be either, so windows
are hashed with all of these as words and with all of them as names; no other sentence of the text has a say. A third
hash has all slot values left in. Windows of ``WINDOW`` tokens are hashed in these three forms, the first two only
with ``LEAST_SPARSE`` literal words; document windows are hash-joined with the windows of the benchmark. A match extends
over consecutive windows on one diagonal (document position minus item position). On it, the slots are checked: equal
benchmark values must stand for equal document values and different ones for different ones, so a question with
consistently exchanged numbers and names is caught, and chance agreement of templates is not. A diagonal is cut at a
slot that clashes; of its parts those of ``LEAST_RUN`` tokens count, and verbatim stretches of a window or more.

An item is found in a document if its consistent matches cover ``LEAST_RUN`` tokens, or all windows of a shorter item.
Template windows with fewer than ``LEAST_LITERALS`` literal words (or than their size) count only in an unbroken
consistent run of ``LEAST_SPARSE_RUN`` tokens, ``LEAST_LITERALS`` of them the same in both, or of the whole item. A window with fewer than
``LEAST_SPARSE`` literal words is found verbatim only. An item of fewer words than a window is found wherever all of its
words stand in a row, however few they are; one without any word is never found.

The benchmark is cut into blocks of at most ``MOST_CHARS`` characters (a longer item is a block of its own), and each
block is broadcast and held against all documents: the same functions at any size, no document is shuffled.

Result: doc_id, item_id, n_windows, covered (tokens), item_tokens, n_slots, n_changed, kind (exact, or reparameterised
if a slot changed), one row per document row and item found. Texts that are null or shorter than a window match
nothing but items that are as short; items shorter than a window are one window of all their tokens. Null ids are
carried as they are. Repeated rows give repeated results, repeated items count once per id. Very long texts are taken
whole, in memory in proportion to the longest one. Other columns, whatever their names, are left alone. Empty tables
give no rows.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import bounded, only, worker_cache

WINDOW, LEAST_LITERALS, LEAST_RUN = 8, 5, 12
LEAST_SPARSE, LEAST_SPARSE_RUN = 3, 14
MOST_CHARS = 8_000_000
LITERAL, NUMBER, UNIT, NAME = range(4)
UNITS = "mm cm m km in ft yd mi miles mile meters metres kilometers kilometres mg g kg t lb lbs oz grams kilograms pounds ml l liters litres gallons s sec seconds min minutes h hr hours days weeks months years dollars cents euros usd eur gbp percent degrees c f k hz khz mhz ghz kb mb gb tb w kw mph kmh v a j kj n pa".split()
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
NUMERIC = re.compile(rb"\d[\d.,:/]*([a-z]{1,4}|\xc2\xb5[a-z]{0,3})?")
WHITE = re.compile(r"\s")


def hashes_of(strings: list[str]) -> np.ndarray:
    return tokens.words(pa.array(strings, pa.large_string())).hash


class Lookup:
    """Membership in a set of hashes: a table of low bits first, then a search in the sorted hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.mask = np.uint64((1 << max(12, (16 * max(1, len(self.hashes)) - 1).bit_length())) - 1)
        self.table = np.zeros(int(self.mask) + 1, bool)
        self.table[self.hashes & self.mask] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """The places in ``h`` of members."""
        at = np.flatnonzero(self.table[h & self.mask])
        if not len(at):
            return at
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        return at[self.hashes[k] == h[at]]


IS_UNIT, IS_NUMBER_WORD = Lookup(hashes_of(UNITS)), Lookup(hashes_of(NUMBER_WORDS))
PLACE = np.concatenate([np.zeros(1, np.uint64), hashes_of(["num", "unit", "name"]) ^ np.uint64(0x5BF03635F0935AD1)])


class Template:
    """The template tokens of a slice of texts. Sentence starts are words in kinds and hashes."""

    def __init__(self, texts: pa.Array):
        self.words = w = tokens.words(texts, marks=True)
        self.first = w.first
        self.cores = w.hash
        self.kinds = np.zeros(len(w.hash), np.int8)
        begins = np.zeros(len(w.hash) + 1, bool)
        begins[w.first] = True
        number = [i for i in np.flatnonzero(w.digit).tolist() if NUMERIC.fullmatch(w.low[w.a[i] : w.b[i]].tobytes())]
        self.kinds[number] = NUMBER
        self.kinds[IS_NUMBER_WORD.find(w.hash)] = NUMBER
        unit = IS_UNIT.find(w.hash)
        unit = unit[~begins[unit] & (unit > 0)]
        unit = unit[self.kinds[unit - 1] == NUMBER]
        proper = w.proper & (self.kinds == LITERAL)
        proper[unit] = False
        self.kinds[unit] = UNIT
        self.starts = proper & w.start
        self.kinds[proper & ~w.start] = NAME
        self.hashes = np.where(self.kinds == LITERAL, self.cores, PLACE[self.kinds])

    def windows(self, size: int):
        """(place of the first token, hash, sparse) of the windows in each form that lie within one text."""
        n = len(self.cores) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        inside = np.zeros(n, bool)
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            inside[a : max(a, b - size + 1)] = True
        seed = np.uint64(size)
        add = lambda a, b: a + b
        places, hashes, sparse = [np.flatnonzero(inside)], [], [np.zeros(0, bool)]
        hashes.append(tokens.mixed(tokens.windows(self.cores, size) + seed)[places[0]])
        sparse[0] = np.zeros(len(places[0]), bool)
        before = None
        for names in (False, True):
            if names and not self.starts.any():
                break
            h = np.where(self.starts, PLACE[NAME], self.hashes) if names else self.hashes
            literal = (self.kinds == LITERAL) & ~self.starts if names else self.kinds == LITERAL
            count = tokens.windows(literal.astype(np.uint8), size, add)
            h = tokens.windows(h, size)
            use = inside & (count >= min(LEAST_SPARSE, size))
            if names:
                use &= h != before
            before = h
            at = np.flatnonzero(use)
            places.append(at)
            hashes.append(h[at])
            sparse.append(count[at] < min(LEAST_LITERALS, size))
        return np.concatenate(places), np.concatenate(hashes), np.concatenate(sparse)


class Benchmark:
    """The items' templates and an index of their windows. An item is (id, kinds with sentence starts as names, values)."""

    def __init__(self, rows: list[tuple]):
        self.items, at, hs, of, sparse = [], [], [], [], []
        for item_id, text in rows:
            t = Template(pa.array([text or ""], pa.large_string()))
            whole = len(t.cores)
            if whole:
                place, h, few = t.windows(min(WINDOW, whole))
                at.append(place)
                hs.append(h)
                sparse.append(few)
                of.append(np.full(len(place), len(self.items)))
            kinds = t.kinds.copy()
            kinds[t.starts] = NAME
            self.items.append((item_id, kinds, t.words.strings(0)))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        flat = join(hs, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.at, self.of, self.sparse = flat[order], join(at, np.int64)[order], join(of, np.int64)[order], join(sparse, bool)[order]
        self.lookup = Lookup(flat)
        self.sizes = sorted({min(WINDOW, len(k)) for _, k, _ in self.items if len(k)})

    def matches(self, t: Template):
        """(text, (item, windows matched, tokens covered, item's tokens, slots, changed slots)) of each item found."""
        found = defaultdict(set)
        for size in self.sizes:
            place, h, _ = t.windows(size)
            hit = self.lookup.find(h)
            if not len(hit):
                continue
            left, right = np.searchsorted(self.hashes, h[hit], "left"), np.searchsorted(self.hashes, h[hit], "right")
            each = np.repeat(np.arange(len(hit)), right - left)
            k = np.arange(len(each)) - np.repeat(np.cumsum(right - left) - (right - left), right - left) + left[each]
            where = place[hit][each]
            text = np.searchsorted(t.first, where, "right") - 1
            for d, item, diagonal, at, few in zip(text.tolist(), self.of[k].tolist(), (where - t.first[text] - self.at[k]).tolist(), self.at[k].tolist(), self.sparse[k].tolist()):
                found[d, item].add((diagonal, at, few))
        values, now = [], None
        for d, item in sorted(found):
            if d != now:
                values, now = t.words.strings(d), d
            if got := judge(found[d, item], *self.items[item][1:], values):
                yield d, (self.items[item][0], *got)


def consistent(tokens, diagonal, item_kinds, item_values, values, unbroken: bool):
    """The sorted tokens cut where a slot clashes, and at gaps if ``unbroken``."""
    parts, there, back = [], {}, {}
    for t in tokens:
        a = b = None
        if item_kinds[t] != LITERAL:
            a, b = (item_kinds[t], item_values[t]), (item_kinds[t], values[t + diagonal])
        clash = a is not None and (there.get(a, b) != b or back.get(b, a) != a)
        if not parts or clash or unbroken and parts[-1][-1] != t - 1:
            parts.append([])
            there, back = {}, {}
        parts[-1].append(t)
        if a is not None:
            there[a], back[b] = b, a
    return parts


def verbatim(tokens, diagonal, item_values, values, size):
    """The tokens in stretches of ``size`` and more with the item's own values."""
    out, run = set(), []
    for t in tokens:
        if run and run[-1] != t - 1 or item_values[t] != values[t + diagonal]:
            out.update(run if len(run) >= size else ())
            run = []
        if item_values[t] == values[t + diagonal]:
            run.append(t)
    return out.union(run if len(run) >= size else ())


def judge(hits: set, item_kinds, item_values, values):
    """hits: (diagonal, position in the item, sparse); sentence starts are names in item_kinds. None, or (windows,
    covered, item's tokens, slots, changed)."""
    size, whole = min(WINDOW, len(item_kinds)), len(item_kinds)
    firm, every = defaultdict(set), defaultdict(set)
    for diagonal, at, sparse in hits:
        every[diagonal].update(range(at, at + size))
        if not sparse:
            firm[diagonal].update(range(at, at + size))
    covered, n_windows, slots, changed = set(), 0, 0, 0
    for diagonal, tokens in every.items():
        take = set()
        parts = consistent(sorted(firm[diagonal]), diagonal, item_kinds, item_values, values, False)
        for part in parts:
            take.update(part if len(parts) == 1 or len(part) >= LEAST_RUN else verbatim(part, diagonal, item_values, values, size))
        if len(firm[diagonal]) < len(tokens):
            for part in consistent(sorted(tokens), diagonal, item_kinds, item_values, values, True):
                if len(part) == whole or len(part) >= LEAST_SPARSE_RUN and sum(item_values[t] == values[t + diagonal] for t in part) >= LEAST_LITERALS:
                    take.update(part)
        covered |= take
        n_windows += sum(take.issuperset(range(at, at + size)) for at in {at for d, at, _ in hits if d == diagonal})
        slots += sum(item_kinds[t] != LITERAL for t in take)
        changed += sum(item_values[t] != values[t + diagonal] for t in take if item_kinds[t] != LITERAL)
    if len(covered) >= min(LEAST_RUN, whole) and covered:
        return n_windows, len(covered), whole, slots, changed
    return None


SCHEMA = "item_id long, n_windows long, covered long, item_tokens long, n_slots long, n_changed long"


def blocks(benchmark: DataFrame, most_chars: int = MOST_CHARS):
    """The benchmark's different rows with a text in lists of at most ``most_chars`` characters, or one item."""
    items = only(benchmark, "item_id", "text").filter("text is not null").dropDuplicates(["item_id", "text"])
    held, size = [], 0
    for row in items.toLocalIterator():
        if held and size + len(row[1]) > most_chars:
            yield held
            held, size = [], 0
        held.append(tuple(row))
        size += len(row[1])
    if held:
        yield held


def against(docs: DataFrame, rows: list[tuple], columns: list[str], schema: str, made):
    """``made(batch, matches)`` over the batches of ``columns`` (text the last one), with the benchmark rows broadcast."""
    shared, name = bounded(docs.sparkSession).sparkContext.broadcast(rows), f"benchmark-{uuid.uuid4().hex}"

    def run(batches):
        bench = worker_cache(name, lambda: Benchmark(shared.value))
        for b in batches:
            found = ((at + d, m) for at, texts in tokens.slices(b.column(b.num_columns - 1)) for d, m in bench.matches(Template(texts)))
            yield made(b, found)

    return docs.select(*columns).mapInArrow(run, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """doc_id, the columns of SCHEMA, and kind, for each document row and benchmark item found in it."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def made(batch, found):
        rows, got = [], []
        for d, m in found:
            rows.append(d)
            got.append(m)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array([g[k] for g in got], pa.int64()) for k in range(6)], ["doc_id", *names])

    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = [against(d, rows, ["doc_id", "text"], "doc_id long, " + SCHEMA, made) for rows in blocks(benchmark, most_chars)]
    none = docs.sparkSession.createDataFrame([], "doc_id long, " + SCHEMA)
    return reduce(DataFrame.unionByName, parts or [none]).withColumn("kind", F.when(F.col("n_changed") > 0, "reparameterised").otherwise("exact"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """The rows of ``docs`` without a benchmark item in their text, with their own columns. Rows are judged one by one
    where they stand, whatever their doc_id."""
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["`text`"].alias("text"))
    kinds = dict(packed.dtypes)

    def made(batch, found):
        keep = np.ones(batch.num_rows, bool)
        keep[[d for d, _ in found]] = False
        return batch.filter(pa.array(keep))

    for rows in blocks(benchmark, most_chars):
        packed = against(packed, rows, ["row", "text"], f"row {kinds['row']}, text string", made)
    return packed.select("row.*")
