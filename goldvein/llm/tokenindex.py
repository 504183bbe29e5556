"""Token-id shards with a minimal perfect hash index (operator 5).

Encoding. A text is cut at ASCII white space into chunks; a tokenizer that drops white space and never merges across
it gives the ids of the text as those of its chunks in turn. This is probed when its file is loaded; a tokenizer that
fails gets whole texts. The distinct chunks of a slice of texts that the worker doesn't know yet (see ``idcache``) go
through the tokenizers library, many in a row between separators. Whole texts are encoded, none is shortened.

Shards. Documents are range-partitioned by doc_id; each task writes one shard: ids as little-endian unsigned integers
of two bytes (four where the vocabulary is larger), nothing between them, documents in ascending doc_id.

Index. Keys fall into buckets by hash; each bucket file holds a minimal perfect hash of its keys (levels of bit
arrays: a bit is set where exactly one key of the level lands, the rest moves on to the next level; a key's slot is
the rank of its bit) and per slot a stored fingerprint, shard, offset and length. A lookup touches one bit per level
(1.6 on average), one rank block and one slot: constant time whatever the corpus size. A key that isn't indexed fails
the 32-bit fingerprint but for a chance of 2^-32.

Nulls and ties: a null text is an empty one; a null doc_id sorts first. Rows that share a doc_id are told apart by
their number among them (order: length, then text), which is part of the key. An empty table gives no shard and no row.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import bounded, cut, file_system, fresh_path, only, put_file, worker_cache
from .idcache import IdCache, gathered

END_ID = 2
TOGETHER, SEPARATOR = 64, "\u2021"
KEYS_PER_BUCKET = 200_000
GAMMA = 2.0
SEED_STEP = 0x9E3779B97F4A7C15
SLOT = np.dtype([("fp", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u4")])


def id_type(tokenizer_file: str) -> str:
    """Two bytes an id where the vocabulary allows, else four."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_file).get_vocab_size() <= 1 << 16 else "<u4"


PROBES = ["Az'S zA 12,3 x", "  lead", "trail ", "a\t\tb\nc\r\x0b\x0c d", "é ñ. (q) ; ! don't  stop", "\n", "x-y 1.5 [CLS] </s> <s>"]


def encoder(tokenizer_file: str, kind: str, ending: np.ndarray):
    """texts (an Arrow array) -> (ids of each text, all ids as ``kind``), each text's ids with ``ending`` behind them."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file)
    tok.encode_special_tokens = True
    ids = lambda t: tok.encode(t, add_special_tokens=False).ids
    apart = all(ids(p) == sum(map(ids, [x.decode() for x in p.encode().split()]), []) for p in PROBES)
    # ASCII letters may be lowered before the lookup where the tokenizer lowers all letters anyway
    fold = apart and all(ids(p) == ids(p.lower()) for p in PROBES)

    mark = np.array(ids(SEPARATOR), kind)

    def alone(chunks: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, kind) for e in tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def learn(chunks: list[str]) -> list[tuple[np.ndarray, bool]]:
        out: list = [None] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if SEPARATOR not in c] if apart else []
        rows = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        for row, got in zip(rows, alone([f" {SEPARATOR} ".join([chunks[i] for i in row]) for row in rows])):
            hit = np.ones(max(0, len(got) - len(mark) + 1), bool)
            for k in range(len(mark)):
                hit &= got[k : k + len(hit)] == mark[k]
            at = np.flatnonzero(hit)
            if len(at) == len(row) - 1:
                for i, x, y in zip(row, [0, *(at + len(mark)).tolist()], [*at.tolist(), len(got)]):
                    out[i] = (got[x:y], True)
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, alone([chunks[i] for i in rest])):
            out[i] = (x, True)
        return out

    cache = IdCache(learn, kind)

    def some(texts) -> tuple[np.ndarray, np.ndarray]:
        if apart:
            chunks = pc.ascii_split_whitespace(pc.ascii_lower(texts) if fold else texts)
            ends = chunks.offsets.to_numpy()[1:] - chunks.offsets[0].as_py()
            coded = chunks.flatten().dictionary_encode()
        else:
            ends, coded = np.arange(1, len(texts) + 1), texts.dictionary_encode()
        start, n, _ = cache.get(coded.dictionary)
        codes = np.insert(coded.indices.to_numpy(zero_copy_only=False), ends, len(n))  # the ending is one more chunk of each text
        flat = np.concatenate([cache.ids[: cache.used], ending])
        start, n = np.append(start, cache.used)[codes], np.append(n, len(ending))[codes]
        return np.diff(np.cumsum(n)[ends + np.arange(len(ends))], prepend=0), gathered(flat, start, n)

    def encode(texts):
        parts = [some(t) for _, t in tokens.slices(texts)] or [(np.zeros(0, np.int64), np.zeros(0, kind))]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    return encode


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser (splitmix64) of keys and a seed."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * SEED_STEP) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def key_hash(ids, ordinals) -> np.ndarray:
    """64-bit hashes of (doc_id or None, number among rows of that id)."""
    raw = np.array([0 if i is None else i for i in ids], dtype=np.int64).astype(np.uint64)
    null = np.array([i is None for i in ids], dtype=np.uint64)
    return mix(mix(raw, 1) + null, 2) ^ mix(np.asarray(ordinals, dtype=np.uint64), 3)


class Mphf:
    """Minimal perfect hash of 64-bit keys that are all different."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bits of each level as bytes 0/1
        self.starts = np.concatenate([[0], np.cumsum([int(x.sum()) for x in levels])]).astype(np.int64)
        self.ranks = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)[:-1]]) if len(x) else x for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> "Mphf":
        levels, left = [], keys
        while len(left):
            size = max(64, int(GAMMA * len(left)))
            at = (mix(left, 10 + len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("two keys have the same 64-bit hash")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 if it lands on no bit (surely not indexed)."""
        out, todo = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            at = (mix(keys[todo], 10 + i) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[todo[hit]] = self.starts[i] + self.ranks[i][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return out

    def dump(self) -> bytes:
        parts = [struct.pack("<I", len(self.levels))]
        for x in self.levels:
            parts += [struct.pack("<Q", len(x)), np.packbits(x).tobytes()]
        return b"".join(parts)

    @classmethod
    def load(cls, blob: bytes) -> tuple["Mphf", int]:
        (n,), at, levels = struct.unpack_from("<I", blob), 4, []
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", blob, at)
            at += 8
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, (size + 7) // 8, at), count=size))
            at += (size + 7) // 8
        return cls(levels), at


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 7) >> np.uint64(32)).astype(np.uint32)


def build_bucket(keys: np.ndarray, shard, offset, n) -> bytes:
    """The bytes of a bucket's index file."""
    h = Mphf.build(keys)
    table = np.zeros(len(keys), SLOT)
    at = h.slots(keys)
    table["fp"][at], table["shard"][at], table["offset"][at], table["n"][at] = fingerprint(keys), shard, offset, n
    return h.dump() + table.tobytes()


def probe_bucket(blob: bytes, keys: np.ndarray):
    """(found, slots' rows) of the keys in a bucket's index file."""
    h, at = Mphf.load(blob)
    table = np.frombuffer(blob, SLOT, offset=at)
    slot = h.slots(keys)
    rows = table[np.maximum(slot, 0)] if len(table) else np.zeros(len(keys), SLOT)
    return (slot >= 0) & (rows["fp"] == fingerprint(keys)) & (len(table) > 0), rows


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys, 5) % np.uint64(buckets)).astype(np.int64)


def write_shards(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = END_ID) -> DataFrame:
    """Write the id shards; a written table of (doc_id, ordinal, shard, pos, at, n_tokens), ``at`` in ids."""
    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = d.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.length("text"), "text"
    )
    kind = id_type(tokenizer_file)
    bounded(docs.sparkSession)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode = worker_cache(f"ids:{tokenizer_file}", lambda: encoder(tokenizer_file, kind, np.asarray([end_id], dtype=kind)))
        out, store, path = None, None, None
        at, pos, last, ordinal = 0, 0, object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store, path = file_system(f"{folder}/ids/shard-{shard:06d}.bin")
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                out = store.open_output_stream(part, compression=None)
            counts, ids = encode(batch.column(1))
            out.write(ids.tobytes())
            ords = []
            for i in batch.column(0).to_pylist():
                ordinal = ordinal + 1 if i == last else 0
                last = i
                ords.append(ordinal)
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ords, pa.int64()), pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(pos, pos + n)), pa.array(at + np.cumsum(counts) - counts), pa.array(counts)],
                ["doc_id", "ordinal", "shard", "pos", "at", "n_tokens"],
            )
            at, pos = at + len(ids), pos + n
        if out is not None:  # rows are sorted, so a task that is run again moves the same bytes here
            out.close()
            store.move(part, path)

    return cut(ordered.mapInArrow(write, "doc_id long, ordinal long, shard int, pos long, at long, n_tokens long"), "shard-rows")


def with_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    def tag(batches):
        import pyarrow as pa

        for b in batches:
            keys = key_hash(b.column("doc_id").to_pylist(), b.column("ordinal").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys.view(np.int64)), pa.array(bucket_of(keys, buckets))], [*b.schema.names, "key", "bucket"])

    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(tag, f"{fields}, key long, bucket long")


def build_index(rows: DataFrame, folder: str, keys_per_bucket: int = KEYS_PER_BUCKET) -> int:
    """Write the bucket files for the shard rows; how many buckets there are. Buckets are even: keys are hashed."""
    buckets = max(1, -(-rows.count() // keys_per_bucket))

    def build(pdf):
        import pandas as pd

        b = int(pdf["bucket"].iloc[0])
        blob = build_bucket(pdf["key"].to_numpy().view(np.uint64), pdf["shard"], pdf["at"], pdf["n_tokens"])
        put_file(f"{folder}/index/bucket-{b:06d}.mph", lambda out: out.write(blob))
        return pd.DataFrame({"bucket": [b], "keys": [len(pdf)]})

    done = with_bucket(rows, buckets).select("bucket", "key", "shard", "at", "n_tokens").groupBy("bucket").applyInPandas(build, "bucket long, keys long")
    cut(done, "buckets")
    return buckets


def lookup(keys: DataFrame, folder: str, buckets: int) -> DataFrame:
    """(doc_id, ordinal) rows -> the same with found, shard, at, n_tokens from the index files."""

    def find(pdf):
        import pandas as pd

        store, path = file_system(f"{folder}/index/bucket-{int(pdf['bucket'].iloc[0]):06d}.mph")
        with store.open_input_stream(path) as f:
            found, got = probe_bucket(f.read(), pdf["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"doc_id": pdf["doc_id"], "ordinal": pdf["ordinal"], "found": found, "shard": got["shard"].astype(np.int32), "at": got["offset"].astype(np.int64), "n_tokens": got["n"].astype(np.int64)})

    # ids travel as text: pandas would turn a long column with nulls into floats
    tagged = with_bucket(keys.select("doc_id", "ordinal"), buckets).withColumn("doc_id", F.col("doc_id").cast("string"))
    found = tagged.groupBy("bucket").applyInPandas(find, "doc_id string, ordinal long, found boolean, shard int, at long, n_tokens long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def read_back(found: DataFrame, folder: str, kind: str, piece: int = 16_384) -> DataFrame:
    """Rows with (shard, at, n_tokens) -> those with the crc32 of the ids read from the shard files.

    Rows are dealt by (shard, block of offsets), so that neighbours in a file are read together by one task and a
    large shard is read by many."""
    width = int(kind[-1])

    def read(batches):
        import pyarrow as pa

        handles = {}
        for b in batches:
            crc = []
            for s, at, n in zip(b.column("shard").to_pylist(), b.column("at").to_pylist(), b.column("n_tokens").to_pylist()):
                if s not in handles:
                    for f in handles.values():
                        f.close()
                    store, path = file_system(f"{folder}/ids/shard-{s:06d}.bin")
                    handles = {s: store.open_input_file(path)}
                handles[s].seek(at * width)
                crc.append(zlib.crc32(np.frombuffer(handles[s].read(n * width), kind).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(crc, pa.int64())], [*b.schema.names, "ids_crc32"])
        for f in handles.values():
            f.close()

    dealt = found.repartition("shard", F.expr(f"at div {piece * 64}")).sortWithinPartitions("shard", "at")
    fields = ", ".join(f"{n} {t}" for n, t in dealt.dtypes)
    return dealt.mapInArrow(read, f"{fields}, ids_crc32 long")


def fetch(folder: str, doc_id: int | None, ordinal: int = 0):
    """The ids of one document by its key, or None: one bucket file, one slot, one read of the shard."""
    read = lambda uri: (lambda store, path: store.open_input_stream(path).read())(*file_system(uri))
    meta = json.loads(read(f"{folder}/meta.json"))
    key = key_hash([doc_id], [ordinal])
    found, rows = probe_bucket(read(f"{folder}/index/bucket-{bucket_of(key, meta['buckets'])[0]:06d}.mph"), key)
    if not found[0]:
        return None
    width = int(meta["kind"][-1])
    store, path = file_system(f"{folder}/ids/shard-{rows['shard'][0]:06d}.bin")
    with store.open_input_file(path) as f:
        f.seek(int(rows["offset"][0]) * width)
        return np.frombuffer(f.read(int(rows["n"][0]) * width), meta["kind"])


def shard_bases(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(shard, base): ids in all shards before it. There is one row a shard: a bounded window."""
    per = rows.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    return per.select("shard", F.expr("coalesce(sum(ids) over (order by shard rows between unbounded preceding and 1 preceding), 0L)").alias("base"))


def encode_and_index(spark: SparkSession, docs: DataFrame, tokenizer_file: str, folder: str | None = None) -> DataFrame:
    """Write shards and index for ``docs``, then read every document back by its key.

    Returns doc_id, start, n_tokens, ids_crc32, shard, shard_offset (ids)."""
    folder = folder or fresh_path(spark, "token-ids")
    rows = write_shards(docs, folder, tokenizer_file)
    buckets, kind = build_index(rows, folder), id_type(tokenizer_file)
    put_file(f"{folder}/meta.json", lambda out: out.write(json.dumps({"buckets": buckets, "kind": kind}).encode()))
    sure = F.when(F.col("found"), True).otherwise(F.raise_error(F.concat(F.lit("not in its index: "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).cast("boolean"))
    found = lookup(rows, folder, buckets).filter(sure).drop("found", "ordinal")
    got = read_back(found, folder, kind)
    return got.join(shard_bases(spark, rows), "shard").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard", F.col("at").alias("shard_offset")
    )
