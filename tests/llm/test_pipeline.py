"""The pipeline against a brute-force version in plain Python, over a small table."""

import math
import random
import re
import zlib

import pytest

from goldvein.llm import queries

from .test_contracts import pii_spans
from .test_methods import brute_classes, words_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus():
    rng = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ro", "su", "ta", "vi") for c in ("x", "zen", "qua", "l")]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    rows = [(i, text(rng.randint(20, 90)), "en", f"s{i % 2}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0", 0) for i in range(5)] + [(110 + i, rows[i + 10][1] + " extra", "en", "s1", 0) for i in range(5)]
    rows += [(120, "#*$ " * 30 + text(40), "en", "s0", 0), (121, "same five words here again " * 20, "en", "s0", 0), (122, "short", "en", "s0", 0), (123, None, None, None, None), (124, "", "en", "s0", 0)]
    rows += [(130, f"{text(20)} mail a.b@mail.example.com or +1 (269) 555-3296 at 10.0.0.1 {text(20)}", "en", "s1", 0)]
    item = text(25)
    rows += [(140, f"{text(20)} {item} {text(15)}", "de", "s1", 0)]
    return rows, [(1, item), (2, text(30))]


def fences(rows):
    """Fences by (lang, source), recomputed from the bins by sorting."""
    from goldvein.llm import quality as q

    bins = {}
    for lang, source, m in rows:
        for name, v in m.items():
            for key in ((lang, source), (lang, None, 1), (None, None, 0)):
                bins.setdefault((key, name), []).append(round(math.log(1 + v) * q.BINS_PER_E))

    def fence(key, name):
        b = sorted(bins[key, name])
        at = lambda p: math.exp(b[math.ceil(p * len(b)) - 1] / q.BINS_PER_E) - 1
        m = at(0.5)
        return len(b), max(q.FLOORS[name], m + q.SPREAD * max(at(0.75) - m, q.REL * m)), min(m - q.FLOORS[name], m - q.SPREAD * max(m - at(0.25), q.REL * m))

    def limit(lang, source, name):
        n, high, low = fence((lang, source), name)
        k, *over = fence((lang, None, 1), name)
        above, below = over if k >= q.LEAST_ROWS else fence((None, None, 0), name)[1:]
        high, low = (min(high, q.WIDEST * above), max(low, below / q.WIDEST)) if n >= q.LEAST_ROWS else (above, below)
        return low if name in q.LOW else -1, high

    return limit


def kept_rows(rows):
    white, out, facts = r"[^\x20\x09-\x0D]+", [], []
    for r in rows:
        t = r[1] or ""
        w = re.findall(white, t)
        wins = {}
        for k in range(len(w) - 4):
            wins.setdefault(tuple(w[k : k + 5]), []).append(k)
        hit = {k + j for ks in wins.values() if len(ks) > 1 for k in ks for j in range(5)}
        if len(w) < 10 or 100 * len(hit) > 20 * len(w):
            continue
        lines, chars = [x for x in t.split("\n") if re.search(white, x)], sum(map(len, w))
        m = {
            "symbol_ppm": len(re.findall(r"[#*$%&|<>]", t)) * 10**6 // chars, "upper_ppm": len(re.findall("[A-Z]", t)) * 10**6 // chars, "dup_line_ppm": (len(lines) - len(set(lines))) * 10**6 // len(lines),
            "word_mil": chars * 1000 // len(w), "mark_ppm": len(re.findall("[!?]", t)) * 10**6 // chars, "repeat_ppm": len(hit) * 10**6 // len(w),
        }
        facts.append((r[2], r[3], m))
        out.append(r)
    limit = fences(facts)
    return [r for r, (lang, source, m) in zip(out, facts) if all(limit(lang, source, n)[0] <= v <= limit(lang, source, n)[1] for n, v in m.items())]


def holds(text, item):
    t, w = words_of(text), words_of(item)
    return any(t[i : i + len(w)] == w for i in range(len(t) - len(w) + 1))


def brute(rows, bench):
    rows = kept_rows(rows)
    classes = {i: c for i, c, _ in brute_classes([(r[0], r[1]) for r in rows])}
    rows = [r for r in rows if classes[r[0]] == r[0]]
    rows = [r for r in rows if not any(holds(r[1], item) for _, item in bench)]
    out = []
    for r in rows:
        text = r[1]
        for kind, a, b in sorted(pii_spans(text), key=lambda s: -s[1]):
            text = f"{text[:a]}<{kind.upper()}>{text[b:]}"
        out.append((r[0], text))
    return out


def test_pipeline(spark, tmp_path):
    import sentencepiece

    rows, bench = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    peer = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    want = {i: (peer.encode(t), zlib.crc32(t.encode())) for i, t in brute(rows, bench)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (list(r.ids), r.decoded_crc32) for r in got} == want and all(r.round_trip and r.parity for r in got) and len(got) == len(want)
    assert 120 not in want and 121 not in want and 140 not in want and 130 in want
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_extra_columns_and_odd_rows(spark, tmp_path):
    """Columns named like those the operators make, repeated rows, null ids, and a very long text."""
    rows, bench = corpus()
    rows = [(*r, f"k{i}", i, "w", None, "t", "c") for i, r in enumerate([*rows, rows[0], (None, rows[1][1] + " more words than before here", "en", "s0", 0), (500, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(17_000)), "en", "s1", 0)])]
    names = "doc_id long, text string, lang string, source string, n_chars long, row string, tk long, node string, _row string, _doc string, n_words string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.dtypes == docs.dtypes, name
        assert {r.row for r in got.select("row").collect()} <= {r[5] for r in rows}
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in last]
    assert len(ids) == len(set(ids)) and {130, 0} <= set(ids) and all(r.parity and r.round_trip for r in last)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
