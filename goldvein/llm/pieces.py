"""SentencePiece models run by the tokenizers library (operator 3).

``parse_model`` reads the model protobuf by its public field numbers. ``build`` makes a tokenizers ``Tokenizer`` from
it: the normaliser (character map, white-space rules), the metaspace marker, BPE merges or unigram scores, and byte
fallback. Where no piece holds a marker after another character (so nothing merges across the start of a word), a
text is cut into words, and the distinct words of a slice of texts that the worker doesn't know yet (see ``idcache``) are
encoded; else texts go through whole. New words are joined by ``TOGETHER``, the library encodes the rows on its
threads, and the ids are cut where a piece begins with the marker. All ids are the tokenizers library's. Each is compared with the sentencepiece library's: ``parity`` is false for a text where the two differ.

Decoding goes from the ids alone: pieces are joined, byte pieces become bytes, markers become spaces.

Null text: treated as empty, no ids. Empty table: no rows. Repeated rows: each is encoded. Other columns, whatever
their names, are ignored. A very long text is a slice of its own and is encoded whole.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import bounded, only, worker_cache
from .idcache import IdCache, gathered

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
TOGETHER = 100


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    treat_whitespace_as_suffix: bool = False


def wire(blob: bytes):
    """(field number, value) pairs of a protobuf message: ints, or bytes for the other wire types."""

    def varint(at):
        value = shift = 0
        while True:
            byte = blob[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(blob):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            n, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(at)
            value, at = blob[at : at + n], at + n
        yield tag >> 3, value


def parse_model(blob: bytes) -> Model:
    """ModelProto: 1 pieces (1 text, 2 score, 3 type), 2 trainer (3 model type, 24 whitespace as suffix, 35 byte
    fallback, 40 unk id), 3 normalizer (2 character map, 3 dummy prefix, 4 extra white space, 5 escape)."""
    m = Model()
    for number, value in wire(blob):
        if number == 1:
            f = dict(wire(value))
            m.pieces.append((f.get(1, b"").decode("utf-8"), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
        elif number == 2:
            f = dict(wire(value))
            m.kind, m.byte_fallback, m.unk_id = f.get(3, UNIGRAM), bool(f.get(35, 0)), f.get(40, 0)
            m.treat_whitespace_as_suffix = bool(f.get(24, 0))
        elif number == 3:
            f = dict(wire(value))
            m.charsmap = f.get(2, b"")
            m.add_dummy_prefix, m.remove_extra_whitespaces, m.escape_whitespaces = (bool(f.get(k, 1)) for k in (3, 4, 5))
    return m


def words_are_apart(m: Model) -> bool:
    """True if no piece holds a marker after another character, and normalising can't look across a word's start."""
    return not m.charsmap and not m.treat_whitespace_as_suffix and not m.remove_extra_whitespaces and not any(
        re.search(f"[^{MARK}]{MARK}", p) or (kind == USER) for p, _, kind in m.pieces
    )


def build(m: Model):
    """The tokenizers ``Tokenizer`` of a model, without the dummy prefix, which ``Codec`` adds."""
    from tokenizers import Regex, Tokenizer, models, normalizers

    if m.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {m.kind} has no counterpart")
    if m.kind == UNIGRAM:
        tok = Tokenizer(models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, m.byte_fallback))
    else:
        ids = {p: i for i, (p, _, kind) in enumerate(m.pieces)}
        usable = {p: s for p, s, kind in m.pieces if kind in (NORMAL, USER)}
        merges = [
            (-score, ids[p[:i]], ids[p[i:]], p[:i], p[i:])
            for p, score in usable.items()
            for i in range(1, len(p))
            if p[:i] in usable and p[i:] in usable
        ]
        merges.sort()
        tok = Tokenizer(models.BPE(vocab=ids, merges=[(a, b) for *_, a, b in merges], unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback))
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tok.normalizer = normalizers.Sequence(steps)
    return tok


class Codec:
    """Encodes and decodes texts by a SentencePiece model file."""

    def __init__(self, blob: bytes):
        import sentencepiece

        self.model = parse_model(blob)
        self.tok = build(self.model)
        self.peer = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.apart = words_are_apart(self.model)
        self.cache = IdCache(self._learn, "<u4")
        raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.encode() for p, _, kind in self.model.pieces]
        raw[self.model.unk_id] = " ⁇ ".encode()
        if self.model.escape_whitespaces:
            raw = [x.replace(MARK.encode(), b" ") if kind != BYTE else x for x, (_, _, kind) in zip(raw, self.model.pieces)]
        self.raw_lens = np.array([len(x) for x in raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_lens) - self.raw_lens
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.marked = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.prefix = self.model.add_dummy_prefix

    def _mine(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _peers(self, texts: list[str], first: bool) -> list[np.ndarray]:
        """sentencepiece's ids; a text that isn't a whole one is encoded behind a line feed, whose ids go again."""
        if first:
            return [np.array(x, "<u4") for x in self.peer.encode(texts, num_threads=2)]
        skip = len(self.peer.encode("\n"))
        return [np.array(x[skip:], "<u4") for x in self.peer.encode(["\n" + t for t in texts], num_threads=2)]

    def _learn(self, words: list[str]) -> list[tuple[np.ndarray, bool]]:
        if not self.apart:
            peers = self._peers([w[1:] if self.prefix and w else w for w in words], True)
            return [(a, np.array_equal(a, b)) for a, b in zip(self._mine(words), peers)]
        out: list = [None] * len(words)
        # words with one marker, at their start: their ids begin at the pieces that begin with it
        plain = [i for i, w in enumerate(words) if w[:1] == " " and not w.startswith((" ", MARK), 1)] if self.model.escape_whitespaces else []
        rows = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        joined = ["".join([words[i] for i in row]) for row in rows]
        alone = set(range(len(words))).difference(plain)
        for row, a, b in zip(rows, self._mine(joined), self._peers(joined, False)):
            at = np.flatnonzero(self.marked[a])
            if len(at) != len(row) or not np.array_equal(a, b):
                alone.update(row)
                continue
            for i, x, y in zip(row, at.tolist(), [*at[1:].tolist(), len(a)]):
                out[i] = (a[x:y], True)
        rest = sorted(alone)
        for i, a, b in zip(rest, self._mine([words[i] for i in rest]), self._peers([words[i] for i in rest], False)):
            out[i] = (a, np.array_equal(a, b))
        return out

    def _words(self, texts):
        """(words behind each text's end, the words of all texts with their dictionary) of an array of texts."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.apart and self.prefix:
            odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, MARK)))
            if not pc.any(odd).as_py():
                pieces = pc.split_pattern(texts, " ")
                some = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
                counts = np.where(some, np.diff(pieces.offsets.to_numpy()), 0)
                coded = pieces.filter(pa.array(some)).flatten().dictionary_encode()
                return np.cumsum(counts), coded.indices.to_numpy(zero_copy_only=False), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), coded.dictionary, pa.scalar("", pa.large_string()))
        each = [self.words(t) for t in texts.to_numpy(zero_copy_only=False).tolist()]
        coded = pa.array([w for ws in each for w in ws], pa.large_string()).dictionary_encode()
        return np.cumsum([len(ws) for ws in each]), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def words(self, text: str) -> list[str]:
        if self.prefix and text:
            text = " " + text
        if not self.apart:
            return [text] if text else []
        return re.findall(rf"[ {MARK}]+[^ {MARK}]*|[^ {MARK}]+", text)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end of each text's ids, all ids, whether both libraries agree) of an array of texts without nulls."""
        ends, codes, words = self._words(texts)
        start, n, same = self.cache.get(words)
        each = n[codes]
        done, odd = np.concatenate([[0], np.cumsum(each)]), np.concatenate([[0], np.cumsum(~same[codes])])
        return done[ends], gathered(self.cache.ids, start[codes], each), np.diff(odd[ends], prepend=0) == 0

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids."""
        lens = self.raw_lens[ids]
        done = np.cumsum(lens)
        data = self.raw[np.repeat(self.raw_starts[ids] - done + lens, lens) + np.arange(done[-1] if len(done) else 0)]
        text = data.tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode_frame(docs: DataFrame, model_file: str, keep_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_ids, ids_crc32 (little-endian u32), decoded_crc32 (UTF-8), round_trip, parity; and ids."""
    bounded(docs.sparkSession)

    def run(batches):
        import os

        import pyarrow as pa

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        codec = worker_cache(f"pieces:{model_file}", lambda: Codec(open(model_file, "rb").read()))
        for b in batches:
            for at, texts in tokens.slices(b.column(1)):
                ends, ids, parity = codec.encode(texts)
                cuts = [0, *ends.tolist()]
                back = [codec.decode(ids[x:y]) for x, y in zip(cuts, cuts[1:])]
                n = len(texts)
                columns = {
                    "doc_id": b.column(0).slice(at, n),
                    "n_ids": pa.array(np.diff(ends, prepend=0)),
                    "ids_crc32": pa.array([zlib.crc32(ids[x:y].tobytes()) for x, y in zip(cuts, cuts[1:])], pa.int64()),
                    "decoded_crc32": pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()),
                    "round_trip": pa.array([a == c for a, c in zip(texts.to_numpy(zero_copy_only=False).tolist(), back)], pa.bool_()),
                    "parity": pa.array(parity, pa.bool_()),
                }
                if keep_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean, parity boolean"
    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, schema + ", ids array<int>" * keep_ids)
