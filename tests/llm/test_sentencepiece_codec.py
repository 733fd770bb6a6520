import random
import struct

import pytest

from pricewell.llm.sentencepiece_codec import MODEL_PATH, Model, decode, encode, encode_round_trip

WEIRD = ["", " ", "  ", "a", " a", "a ", "  a  b   ", "\n\n", "é漢字 🎉 ab\tcd", "x" * 300, " " * 100 + "x", " " * 33, "\x00a", "<s> </s> <unk> <0x41>", "    def f():\n        return 1\n" * 5, "ﷺ ﬁ Ａ"]


@pytest.fixture(scope="module")
def model():
    return Model.load(MODEL_PATH)


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL_PATH)


def test_equal_to_the_library(model, library):
    r = random.Random(1)
    texts = WEIRD + ["▁x ▁▁y"] + ["".join(r.choice("abct eh▁ \néx.") for _ in range(r.randint(1, 60))) for _ in range(2000)]
    for t in texts:
        ids = model.encode([t])[0].tolist()
        assert ids == library.encode(t), t
        assert model.decode(ids) == library.decode(ids), t
        assert "▁" in t or model.decode(ids) == t


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: library.encode(r.text) for r in docs.collect()}
    got = encode_round_trip(docs).collect()
    assert {r.doc_id: r.ids for r in got} == want and all(r.round_trip and r.n_ids == len(r.ids) for r in got)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "word " * 40_000, 3), (4, "same", 4), (4, "same", 4), (None, "x", 5)], "doc_id long, text string, n_ids int")
    rows = {(r.doc_id, r.text): r for r in decode(encode(docs, carry=["doc_id", "text"])).collect()}
    assert rows[1, None].ids is None and rows[1, None].decoded is None and rows[2, ""].ids == []
    assert all(r.decoded == r.text for r in rows.values())
    assert encode(docs.limit(0)).collect() == []


def _message(number, data):
    return bytes([number << 3 | 2, len(data)]) + data


def test_unigram_is_the_best_sum(spark):
    """A hand-made model of nine pieces: the library and a search over all ways agree with the trie."""
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.9, 1), ("▁ab", -5.0, 1), ("ba", -3.0, 1), ("aba", -7.5, 1), ("bb", -4.0, 1)]
    data = b"".join(_message(1, _message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([3 << 3, t])) for p, s, t in pieces)
    data += _message(2, bytes([3 << 3, 1])) + _message(3, _message(1, b"identity") + bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))
    model, score = Model(data), {p: s for p, s, _ in pieces[1:]}

    def best(w):
        if not w:
            return 0.0
        return max((best(w[:k]) + score[w[k:]] for k in range(len(w)) if w[k:] in score), default=-1e9)

    r = random.Random(2)
    for _ in range(200):
        t = "".join(r.choice("ab ") for _ in range(r.randint(1, 12)))
        got = [model.pieces[i][0] for i in model.encode([t])[0]]
        assert "".join(got) == model.marked(t)
        words = model.marked(t)
        assert abs(sum(score[p] for p in got) - best(words)) < 1e-6
    assert [model.pieces[i][0] for i in model.encode(["azb"])[0]] == ["▁", "a", "<unk>", "b"]
