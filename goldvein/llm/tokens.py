"""Words of many texts at once, as arrays: no Python object a word, no dictionary that grows with the vocabulary.

A chunk is a run of anything but white space; its core is what is left without outer punctuation, in lower case. A
batch of texts is cut into slices of bounded bytes; the bytes of a slice are looked at ``STRIDE`` at a time (cut at
white space), so memory follows the longest text and nothing else. A core's hash is a polynomial in its bytes modulo
2^64, taken from prefix sums, and mixed.

Bytes outside ASCII count as letters, but for the general punctuation, currency, Latin-1 and CJK signs, which are
punctuation. Unicode's spaces are white space. A letter whose lower case takes another number of bytes stays as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE, STRIDE = 1 << 22, 1 << 18
BASE = 0x9DDFEA08EB382D69
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
SPACES = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


CLOSERS, ENDERS = np.zeros(256, bool), np.zeros(256, bool)
CLOSERS[list(b"\"')]}*#$%&|<>")] = True
ENDERS[list(b".!?:")] = True
LETTER_BYTES = np.ones(256, np.int8)
LETTER_BYTES[0xC0:0xE0], LETTER_BYTES[0xE0:0xF0], LETTER_BYTES[0xF0:] = 2, 3, 4
FEW = 16


def is_space(x: np.ndarray) -> np.ndarray:
    return (x == 32) | (x - np.uint8(9) < 5)


def is_letter(x: np.ndarray) -> np.ndarray:
    return ((x | np.uint8(32)) - np.uint8(97) < 26) | (x >= 128)


def is_digit(x: np.ndarray) -> np.ndarray:
    return x - np.uint8(48) < 10


def slices(texts: pa.Array, most: int = SLICE):
    """(first row, texts without nulls) of runs of rows with ``most`` bytes; a longer text is a run of its own."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array of large strings."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            out, have = np.empty(size, np.uint64), 1
            out[0] = 1
            while have < size:  # the first half times base^have is the second
                with np.errstate(over="ignore"):
                    out[have : 2 * have] = out[:have] * np.uint64(pow(base, have, 1 << 64))
                have *= 2
            _powers[k] = out
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x *= K1
        x ^= x >> np.uint64(29)
        x *= K2
        x ^= x >> np.uint64(32)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    with np.errstate(over="ignore"):
        x = a * K1
        x += b
        x ^= x >> np.uint64(31)
        x *= K2
    x ^= x >> np.uint64(32)
    return x


def windows(h: np.ndarray, size: int, join=pair) -> np.ndarray:
    """The joined values of each run of ``size``: doubled up to the largest power of two, the rest put behind."""
    out, at, step = None, 0, 1
    n = len(h) - size + 1
    if n <= 0:
        return h[:0]
    parts, doubled = [], h
    while step <= size:
        if size & step:
            parts.append((step, doubled))
        if 2 * step <= size:
            doubled = join(doubled[: len(doubled) - step], doubled[step:])
        step *= 2
    for step, part in reversed(parts):
        piece = part[at : at + n]
        out = piece if out is None else join(out, piece)
        at += step
    return out


@dataclass
class Words:
    """The words of a slice: those of text d are first[d] to first[d + 1]; bounds a, b of each core in ``low``."""

    low: np.ndarray
    first: np.ndarray
    a: np.ndarray
    b: np.ndarray
    hash: np.ndarray
    proper: np.ndarray | None = None  # a capital, then small letters alone
    start: np.ndarray | None = None  # begins a sentence
    digit: np.ndarray | None = None  # begins with a digit

    def strings(self, d: int) -> list[str]:
        return [self.low[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(self.a[self.first[d] : self.first[d + 1]].tolist(), self.b[self.first[d] : self.first[d + 1]].tolist())]


def lowered(texts: pa.Array) -> pa.Array:
    low = pc.utf8_lower(texts)
    if np.array_equal(buffers(low)[0], buffers(texts)[0]):
        return low
    same = lambda c: c.lower() if len(c.lower().encode()) == len(c.encode()) else c
    return pa.array(["".join(map(same, t)) for t in texts.to_numpy(zero_copy_only=False)], pa.large_string())


def core_bytes(low: np.ndarray) -> np.ndarray:
    """Which bytes are letters or digits: all outside ASCII but those of the signs named above."""
    core = is_letter(low) | is_digit(low)
    second, third = np.zeros_like(low), np.zeros_like(low)
    second[:-1], third[:-2] = low[1:], low[2:]
    two = (low == 0xC2) & (second != 0xAA) & (second != 0xB5) & (second != 0xBA)
    three = (low == 0xE2) & ((second == 0x80) | (second == 0x81) | (second == 0x82) & (third >= 0xA0)) | (low == 0xE3) & (second == 0x80) & (third < 0x92)
    for sign, size in ((two, 2), (three, 3)):
        if sign.any():
            at = np.flatnonzero(sign)
            for i in range(size):
                core[at + i] = False
    return core


def counted(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, dtype=np.int32, out=out[1:])
    return out


def trimmed(core: np.ndarray, start: np.ndarray, end: np.ndarray):
    """The first core byte of each chunk and the place behind its last one; equal if it has none. Chunks with more than
    ``FEW`` outer signs are looked up by counts."""
    a, b = start.copy(), end.copy()
    left = np.flatnonzero(~core[a])
    for _ in range(FEW):
        a[left] += 1
        left = left[(a[left] < b[left])]
        left = left[~core[a[left]]]
    right = np.flatnonzero((a < b) & ~core[b - 1])
    if len(left):
        right = np.setdiff1d(right, left)
    for _ in range(FEW):
        b[right] -= 1
        right = right[~core[b[right] - 1]]
    if len(left) or len(right):
        n, where = counted(core), np.append(np.flatnonzero(core), len(core))
        for i in (left, right):
            has = n[end[i]] > n[start[i]]
            a[i] = np.where(has, where[n[start[i]]], start[i])
            b[i] = np.where(has, where[n[end[i]] - 1] + 1, a[i])
    return a, b


def some_words(low: np.ndarray, raw: np.ndarray, inner: np.ndarray, marks: bool):
    """Of a stretch that begins and ends between chunks: (start, a, b, hash, proper, ends, digit) by chunk; texts begin
    at ``inner`` too."""
    space = is_space(low)
    before, behind = np.ones(len(low), bool), np.ones(len(low), bool)
    before[1:], behind[:-1] = space[:-1], space[1:]
    before[inner], behind[inner - 1] = True, True
    start, end = np.flatnonzero(before & ~space), np.flatnonzero(behind & ~space) + 1
    a, b = trimmed(core_bytes(low), start, end)
    power, inverse = powers(len(low))
    sums = np.zeros(len(low) + 1, np.uint64)
    with np.errstate(over="ignore"):
        value = low.astype(np.uint64)
        value += np.uint64(1)
        value *= power[: len(low)]
        np.cumsum(value, out=sums[1:])
        h = mixed((sums[b] - sums[a]) * inverse[np.minimum(a, len(low) - 1)])
    h |= np.uint64(1)
    h[a == b] = 0
    if not marks:
        return start, a, b, h, None, None, None
    upper = low != raw
    bad = counted(upper | ~is_letter(low))
    at = np.minimum(a, len(low) - 1)
    a1 = np.minimum(a + LETTER_BYTES[low[at]], b)
    proper = (a1 < b) & (upper[at] | upper[a1 - 1]) & (bad[b] == bad[np.minimum(a1, b)])
    last = end - 1
    more = np.flatnonzero(CLOSERS[low[last]] & (last > start))
    while len(more):
        last[more] -= 1
        more = more[CLOSERS[low[last[more]]] & (last[more] > start[more])]
    return start, a, b, h, proper, ENDERS[low[last]], is_digit(low[at])


def words(texts: pa.Array, marks: bool = False) -> Words:
    """The words of an array of large strings without nulls, those without a core left out."""
    offsets, raw = buffers(texts)
    if (raw >= 0xC2).any() and pc.any(pc.match_substring_regex(texts, SPACES)).as_py():
        texts = pc.replace_substring_regex(texts, SPACES, " ")
        offsets, raw = buffers(texts)
    low = buffers(lowered(texts))[1]
    parts, at = [], 0
    cuts = np.unique(offsets)
    while at < len(low):
        to = int(cuts[np.searchsorted(cuts, at + STRIDE, "right") - 1])
        if to <= at:  # inside a long text: up to the next white space
            end, to = int(cuts[np.searchsorted(cuts, at, "right")]), at + STRIDE
            while to < end and not len(gap := np.flatnonzero(is_space(low[to : min(to + STRIDE, end)]))):
                to += STRIDE
            to = to + int(gap[0]) if to < end else end
        got = some_words(low[at:to], raw[at:to], cuts[(cuts > at) & (cuts < to)] - at, marks)
        parts.append([x + at if i < 3 else x for i, x in enumerate(got)])
        at = to
    kinds = [np.int64, np.int64, np.int64, np.uint64, bool, bool, bool]
    start, a, b, h, proper, ends, digit = (np.concatenate([p[i] for p in parts]) if parts and parts[0][i] is not None else np.zeros(0, k) for i, k in enumerate(kinds))
    keep = np.flatnonzero(h)
    first = np.searchsorted(start[keep], offsets, "left")
    out = Words(low, first, a[keep], b[keep], h[keep])
    if marks:
        out.proper, out.digit = proper[keep], digit[keep]
        n_ends = counted(ends)[keep]
        out.start = np.diff(n_ends, prepend=0) > 0
        out.start[first[:-1][first[:-1] < first[1:]]] = True
    return out
