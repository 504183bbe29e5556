"""SentencePiece models through the tokenizers library against the sentencepiece library."""

import struct
from types import SimpleNamespace

import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from goldvein.llm import pieces, queries
from goldvein.llm.idcache import IdCache, short_hashes

CODEC = pieces.Codec(open(queries.tokenizer("piece_bpe_32k.model"), "rb").read())


def coded(codec, texts):
    """[(ids, parity)] of texts, and what they decode to."""
    ends, ids, parity = codec.encode(pa.array(texts, pa.large_string()))
    parts = [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
    return [(p.tolist(), bool(same)) for p, same in zip(parts, parity)], [codec.decode(p) for p in parts]


def clean(text):
    return text.encode("utf-8", "ignore").decode().replace("\0", "")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60) | st.lists(st.sampled_from(["the", " ", "  ", "\n", "Ünïcode", "中", "a", "aa", "▁", "\t", "end."])).map("".join), min_size=1, max_size=6))
def test_bpe_parity_and_round_trip(texts):
    """The ids, which come from the tokenizers library alone, are the sentencepiece library's."""
    texts = [clean(t) for t in texts]
    got, back = coded(CODEC, texts)
    assert [x for x, _ in got] == [CODEC.peer.encode(t) for t in texts] and all(same for _, same in got)
    assert all(a == b for a, b in zip(texts, back) if "▁" not in a)


def test_words_through_the_tokenizers_library():
    """The tokenizers model itself gives the ids; with another backend the ids change and parity says so."""
    codec = pieces.Codec(open(queries.tokenizer("piece_bpe_32k.model"), "rb").read())
    text = " ".join(["the quick brown fox", "jumps over zebras", "Ünïcode 中文 123"] * 40)
    assert codec.tok.encode(" " + text, add_special_tokens=False).ids == codec.peer.encode(text) == coded(codec, [text])[0][0][0]

    class Dummy:
        def encode_batch_fast(self, texts, add_special_tokens):
            return [SimpleNamespace(ids=[7]) for _ in texts]

    codec = pieces.Codec(open(queries.tokenizer("piece_bpe_32k.model"), "rb").read())
    codec.tok = Dummy()
    (ids, same), (none, also) = coded(codec, [text, ""])[0]
    assert set(ids) == {7} and not same and none == [] and also


def test_long_words_and_caches():
    """A table of four places, emptied again and again, gives the same ids."""
    codec = pieces.Codec(open(queries.tokenizer("piece_bpe_32k.model"), "rb").read())
    codec.cache = IdCache(codec._learn, "<u4", slots=4, most_ids=10)
    texts = ["a b c d e f g", "x" * 5_000, "", "g f e d c b a " + "y" * 300 + " z "]
    for _ in range(3):
        got, back = coded(codec, texts)
        assert [x for x, _ in got] == [codec.peer.encode(t) for t in texts] and back == texts


def test_short_hashes():
    """Different words, differing in one place or in length, have different hashes."""
    words = sorted({a * i + b * j for a in "ab\0é" for b in "bc" for i in range(9) for j in range(9)})
    one, two, size = short_hashes(pa.array(words, pa.large_string()))
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(words) and size.tolist() == [len(w.encode()) for w in words]


def field(number, kind, body):
    return bytes([number << 3 | kind]) + body


def message(b):
    n, out = len(b), b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n]) + b


def unigram_model():
    """A hand-made unigram model with byte fallback; nothing is trained."""
    words = {"▁": -2.0, "▁the": -3.0, "the": -4.5, "t": -6.0, "h": -6.0, "e": -6.0, "▁he": -3.5, "n": -6.5, "en": -5.0, "▁a": -3.2, "a": -6.0}
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] + [(w, s, 1) for w, s in words.items()]
    out = b"".join(field(1, 2, message(field(1, 2, message(p.encode())) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k])))) for p, s, k in rows)
    trainer = field(3, 0, b"\x01") + bytes([35 << 3 & 127 | 128, 35 << 3 >> 7]) + b"\x01"
    return out + field(2, 2, message(trainer)) + field(3, 2, message(field(1, 2, message(b"identity")) + field(3, 0, b"\x01") + field(4, 0, b"\x00")))


def test_unigram_parity():
    blob = unigram_model()
    codec, peer = pieces.Codec(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    assert codec.model.kind == pieces.UNIGRAM and codec.model.byte_fallback
    for text in ["the hen", "a then the", "", "zebra", "the  the", "hé"]:
        ((ids, same),), (back,) = coded(codec, [text])
        assert ids == peer.encode(text) and back == text and same


def test_frame(docs, doc_rows):
    got = {(r.doc_id, r.n_ids): r for r in pieces.encode_frame(docs, queries.tokenizer("piece_bpe_32k.model"), True).collect()}
    for i, text, *_ in doc_rows:
        want = CODEC.peer.encode(text or "")
        r = got[i, len(want)]
        assert r.ids == want and r.round_trip and r.parity
