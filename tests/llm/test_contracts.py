"""The queries' contracts against plain Python over small tables with every odd case."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from goldvein.llm import pii, quality, queries, secrets, sharding, tokenindex, warc


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def luhn(s):
    d = [int(c) for c in s[::-1]]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def pii_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] if len(t) < 40_000 else []
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))] if len(t) < 40_000 else []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_pii_base(docs, doc_rows):
    want = []
    for i, text, *_ in doc_rows:
        spans = pii_spans(text or "")
        n = Counter(k for k, _, _ in spans)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined.encode()).hexdigest()))
    got = pii.scan(docs)
    same(got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect(), want)
    for r in got.select("spans", "n_email", "n_ip", "n_card", "n_phone", "n_context").collect():
        assert len([x for x in r.spans.split(",") if x]) == sum(r[1:])


def test_secret_base(docs, doc_rows):
    want = []
    for i, text, *_ in doc_rows:
        t = text or ""
        spans = [("assign", *m.span()) for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 12]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        n = Counter(k for k, _, _ in spans)
        spans.sort(key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))
        want.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    got = secrets.scan(docs)
    same(got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect(), want)
    assert got.filter("n_markov > 0 and spans like '%markov:%'").count() > 5


def test_quality_base(docs, doc_rows):
    white = r"[^\x20\x09-\x0D]+"
    want = []
    for i, text, *_ in doc_rows:
        t = text or ""
        w = re.findall(white, t)
        wins = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if wins[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(white, x)]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed))
    got = quality.quality(docs)
    same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect(), want)
    assert not got.filter("base_failed and kept").count() and dict(got.dtypes)["kept"] == "boolean"


def test_token_index(spark, docs, doc_rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want, at = [], 0
    for i, text, *_ in sorted(doc_rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    same(tokenindex.encode_and_index(spark, docs, queries.tokenizer("word_bpe_49k.json")).select("doc_id", "start", "n_tokens", "ids_crc32").collect(), want)


def test_fetch_by_key(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/ids"
    rows = tokenindex.encode_and_index(spark, docs.filter("doc_id < 40 or doc_id is null"), queries.tokenizer("word_bpe_49k.json"), folder).collect()
    for r in rows[::7]:
        if r.doc_id not in (3, 5):
            assert zlib.crc32(tokenindex.fetch(folder, r.doc_id).astype("<u4").tobytes()) == r.ids_crc32
    assert tokenindex.fetch(folder, 10**6) is None and tokenindex.fetch(folder, 3, 1) is not None and tokenindex.fetch(folder, 3, 9) is None


def test_shards(docs, doc_rows):
    got = sharding.shard(docs).collect()
    same([(r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in got], [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for i, t, *_ in doc_rows])
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(8))
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    for k, rs in by.items():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert abs(sum(r["size"] for r in rs) - total / 8) <= most
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))


def test_shards_of_hot_ids_in_many_rounds(spark):
    """One id with a third of the rows, ids far apart, nulls, and a bound on ranges that takes many rounds."""
    rng = np.random.default_rng(4)
    ids = [7] * 1_000 + [None] * 200 + [int(x) for x in rng.integers(-(2**40), 2**40, 1_800)]
    rows = [(i, "x" * int(n), "clash") for i, n in zip(ids, rng.integers(0, 60, len(ids)))]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, range string"), 12).collect()
    total, by = sum(r["size"] for r in got), {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert len(got) == len(rows) and sorted(by) == list(range(12))
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs))) and abs(sum(r["size"] for r in rs) - total / 12) <= 61
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))


def test_warc(spark):
    html = ["x" * 200, "x" * 200, "y", "y", None, "", "é" * 60, "x" * 200, "z" * 99, "z" * 99, "q" * 100, "q" * 100, "a\r\n\r\nb" * 40]
    rows = [(i, f"http://e/{i}\r\nX: y" if i % 3 else None, h, "clash") for i, h in enumerate(html)] + [(None, "u", "x" * 200, ""), (0, "u", "x" * 200, "")]
    got = warc.write_and_read(spark, spark.createDataFrame(rows, "page_id long, url string, html string, bundle string"))
    first, want = {}, []
    for i, _, h, _ in rows:
        if i is not None:
            first[h] = min(first.get(h, i), i)
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and i != first[h]
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    same(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect(), want)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_empty_tables(spark, no_docs, name, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).collect() == []
