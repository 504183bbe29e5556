"""Token ids by word, kept in arrays: a worker knows a million words in tens of megabytes.

A word's place follows from a 64-bit hash of its bytes; it is known if that hash and a second, independent one stand
there. A new word takes the place of the one before, so the table never grows; words longer than ``LONGEST`` bytes
aren't kept. The ids lie in one array, which is emptied with the table when it is full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .tokens import buffers, mixed

LONGEST, SLOTS, MOST_IDS = 48, 1 << 20, 12_000_000


def short_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two hashes of each word's bytes, bytes); those of words longer than ``LONGEST`` mean nothing."""
    offsets, data = buffers(words)
    size = np.diff(offsets)
    one, two = (size + 1).astype(np.uint64), (size + 1).astype(np.uint64)
    at = np.flatnonzero((size > 0) & (size <= LONGEST))
    k = 0
    with np.errstate(over="ignore"):
        while len(at):
            byte = data[offsets[at] + k].astype(np.uint64)
            one[at] = (one[at] ^ byte) * np.uint64(0x100000001B3)
            two[at] = (two[at] + byte) * np.uint64(0xC6A4A7935BD1E995)
            k += 1
            at = at[size[at] > k]
    return mixed(one), mixed(two), size


class IdCache:
    """``learn``: a list of words -> [(their ids as an array of ``kind``, a flag)]."""

    def __init__(self, learn, kind: str, slots: int = SLOTS, most_ids: int = MOST_IDS):
        self.learn, self.kind, self.most_ids = learn, kind, most_ids
        self.one, self.two = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.start, self.n, self.flag = np.zeros(slots, np.int64), np.full(slots, -1, np.int32), np.zeros(slots, bool)
        self.ids, self.used = np.zeros(1 << 16, kind), 0

    def get(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start in ``ids``, number of ids, flag) of each of the different words (large strings without nulls)."""
        if self.used > self.most_ids:
            self.n[:], self.used, self.ids = -1, 0, np.zeros(1 << 16, self.kind)
        one, two, size = short_hashes(words)
        at = (one & np.uint64(len(self.one) - 1)).astype(np.int64)
        short = size <= LONGEST
        known = short & (self.n[at] >= 0) & (self.one[at] == one) & (self.two[at] == two)
        start, n, flag = np.where(known, self.start[at], 0), np.where(known, self.n[at], 0), known & self.flag[at]
        new = np.flatnonzero(~known)
        if len(new):
            got = self.learn(words.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist())
            n[new] = [len(x) for x, _ in got]
            flag[new] = [f for _, f in got]
            ends = self.used + np.cumsum(n[new])
            start[new] = ends - n[new]
            if ends[-1] > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(int(max(ends[-1], 2 * len(self.ids)) - self.used), self.kind)])
            self.ids[self.used : ends[-1]] = np.concatenate([x for x, _ in got])
            self.used = int(ends[-1])
            new = new[short[new]]
            self.one[at[new]], self.two[at[new]], self.start[at[new]], self.n[at[new]], self.flag[at[new]] = one[new], two[new], start[new], n[new], flag[new]
        return start, n, flag


def gathered(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` put in a row."""
    done = np.cumsum(n)
    return ids[np.repeat(start - done + n, n) + np.arange(done[-1] if len(done) else 0)]
