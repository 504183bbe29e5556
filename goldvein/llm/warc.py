"""WARC records in seekable Zstandard bundles (operator 4).

Each task writes one bundle: records gathered into independent frames of about ``FRAME_BYTES``, then a skippable frame
with the seek table of the seekable Zstandard format (per frame: compressed and plain size; footer: number of frames,
descriptor, magic number), so any reader may start at any frame. An index row maps each record to its bundle,
frame, offset within the plain frame, and length; reading one record decompresses one frame. A bundle's name is drawn
anew for each attempt of a task and comes back in the index rows of that attempt alone, so an attempt that is lost or
run twice leaves a file that no index row names, and never another order of records under a name in use.

Revisits. Records whose payloads have the same SHA-256 and at least ``MIN_REVISIT`` bytes: the one with the smallest
page_id is a response, the others are revisits of it without payload; they carry the digest and length of the full one.
Which is which is settled on a light table without payloads (shorter payloads ride along). Of the others, one copy
a task and digest is shuffled, and goes to the responses alone.

Record ids are UUIDs: of digest and page_id for the responses that others may refer to, else drawn. They are unique but
for rows that repeat both page_id and payload.

Nulls and ties: null html is an empty payload, a null url an empty one; a null page_id sorts last and is written with
an empty number; rows that share the smallest page_id are all responses, and so are all of a payload that comes with
null page_ids only. A very long page is a frame of its own. Other columns, whatever their names, are left alone. An
empty table writes and returns nothing.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, file_system, fresh_path, only

MIN_REVISIT = 100
FRAME_BYTES = 1 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"


def record_id(digest: str, page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest}/{page_id}')}>"


def record(page_id, url, payload: bytes, digest: str, length: int, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit (refers_to given) has no payload."""
    kind = "response" if refers_to is None else "revisit"
    own = record_id(digest, page_id) if refers_to is None and length >= MIN_REVISIT and page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    url = re.sub(r"[\r\n]+", " ", url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {length}", "Content-Type: text/html",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(digest, refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers (lower-case names) and ``payload`` of one record."""
    head, _, body = raw.partition(b"\r\n\r\n")
    out = {k.lower(): v.lstrip(" ") for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    out["payload"] = body[: int(out["content-length"])]
    return out


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle; sizes: (compressed, plain) of each frame."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class Bundle:
    """Reader of a seekable bundle: an open random-access file."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        f.seek(size - 9 - 8 * n)
        table = f.read(8 * n)
        self.frames, at = [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", table, 8 * i)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, i: int) -> bytes:
        import zstandard

        at, packed, plain = self.frames[i]
        self.f.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.f.read(packed), max_output_size=plain)


def open_bundle(uri: str) -> Bundle:
    store, path = file_system(uri)
    return Bundle(store.open_input_file(path), store.get_file_info(path).size)


def to_write(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, refers_to of each record."""
    p = only(pages, "page_id", "url", "html").select(
        "page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    )
    p = p.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    large = F.col("payload_bytes") >= MIN_REVISIT
    light = p.withColumn("payload", F.when(~large, F.col("payload")))
    firsts = light.filter(large).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = F.col("first_id")
    settled = cut(
        light.join(firsts, "payload_digest", "left").select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(first.isNotNull() & ~F.col("page_id").eqNullSafe(first), first).alias("refers_to")),
        "warc-settled",
    )
    full = large & F.col("refers_to").isNull()
    payloads = p.filter(large).groupBy("payload_digest").agg(F.first("payload").alias("full"))
    responses = settled.filter(full).join(payloads, "payload_digest").select("page_id", "url", F.col("full").alias("payload"), "payload_bytes", "payload_digest", "refers_to")
    return responses.unionByName(settled.filter(~full))


def write_bundles(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write the bundles; a written index table (page_id, bundle, frame, at, length)."""
    bounded(pages.sparkSession)
    rows = to_write(pages)

    def write(batches):
        import pyarrow as pa
        import zstandard

        out, name, pack = None, f"bundle-{uuid.uuid4().hex}.warc.zst", zstandard.ZstdCompressor(level=3, write_content_size=True)
        store, path = file_system(f"{folder}/{name}")
        sizes, held, n = [], [], 0

        def flush():
            plain = b"".join(held)
            packed = pack.compress(plain)
            out.write(packed)
            sizes.append((len(packed), len(plain)))
            held.clear()

        for batch in batches:
            if out is None and batch.num_rows:
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = store.open_output_stream(path, compression=None)
            index = []
            for page_id, url, payload, length, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                raw = record(page_id, url, payload or b"", digest, length, refers)
                index.append((page_id, len(sizes), n, len(raw)))
                held.append(raw)
                n += len(raw)
                if n >= frame_bytes:
                    flush()
                    n = 0
            columns = list(zip(*index)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array([name] * len(index), pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["page_id", "bundle", "frame", "at", "length"])
        if out is not None:
            if held:
                flush()
            out.write(seek_table(sizes))
            out.close()

    return cut(rows.mapInArrow(write, "page_id long, bundle string, frame long, at long, length long"), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that index rows point to: page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    bundle, frame, at. Digest and length of a response are taken from the payload read; a revisit's from its headers.

    Rows are dealt by (bundle, run of 16 frames): a frame is decompressed once, a large bundle is read by many."""

    def read(batches):
        import pyarrow as pa

        now, bundle, frame_at, plain = None, None, None, b""
        for b in batches:
            out = []
            for page_id, name, frame, at, length in zip(*(b.column(c).to_pylist() for c in ("page_id", "bundle", "frame", "at", "length"))):
                if name != now:
                    if bundle is not None:
                        bundle.f.close()
                    now, bundle, frame_at = name, open_bundle(f"{folder}/{name}"), None
                if frame != frame_at:
                    frame_at, plain = frame, bundle.frame(frame)
                r = parse(plain[at : at + length])
                if r["x-page-id"] != ("" if page_id is None else str(page_id)):
                    raise ValueError(f"record of page {r['x-page-id']} stands where {page_id} was indexed")
                if r["warc-type"] == "response":
                    size, digest, refers = len(r["payload"]), hashlib.sha256(r["payload"]).hexdigest(), None
                else:
                    size, digest = int(r["x-payload-length"]), r["warc-payload-digest"].partition(":")[2]
                    refers = int(r["x-refers-to-page-id"])
                out.append((page_id, size, digest, r["warc-type"], refers, r["warc-target-uri"], name, frame, at))
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "bundle", "frame", "at"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    dealt = index.repartition("bundle", F.expr("frame div 16")).sortWithinPartitions("bundle", "frame", "at")
    return dealt.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, bundle string, frame long, at long")


def write_and_read(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write one record per row of ``pages`` and return what is read back from the archives."""
    folder = folder or fresh_path(spark, "warc")
    return read_records(write_bundles(pages, folder), folder)
