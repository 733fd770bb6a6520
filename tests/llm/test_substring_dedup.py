import hashlib
import random
import re

import numpy as np
import pytest

from pricewell.llm.common import word_hashes
from pricewell.llm.substring_dedup import drop_repeated_windows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows, width=20):
    first, split = {}, []
    for d, t in rows:
        w = WORDS.findall(t or "")
        split.append((d, w))
        for i in range(len(w) - width + 1):
            k, at = tuple(w[i : i + width]), (d is not None, d, i)
            first[k] = min(first.get(k, at), at)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] != (d is not None, d, i):
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def same(spark, rows, width=20):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, found string, n_words int")
    got = sorted((tuple(r) for r in drop_repeated_windows(docs, width, digest=True).collect()), key=str)
    assert got == slow(rows, width)


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in drop_repeated_windows(docs, digest=True).collect()), key=str)
    assert got == slow(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_pieces(spark, seed):
    """Few words, so runs, periods and chance repeats abound."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2 + 10 * seed)]
    pieces = [[r.choice(vocabulary) for _ in range(r.randint(15, 60))] for _ in range(8)] + [["a"] * 45, ["a", "b"] * 25]
    rows = []
    for d in range(60):
        words = []
        for _ in range(r.randint(0, 5)):
            words += r.choice(pieces) if r.random() < 0.5 else [r.choice(vocabulary) for _ in range(r.randint(1, 30))]
        rows.append((d, " ".join(words)))
    r.shuffle(rows)
    same(spark, rows)


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    text = " ".join(f"t{i}" for i in range(25))
    same(spark, [(1, None), (2, ""), (3, "a b c"), (4, long), (5, long), (6, text), (None, text), (7, text.replace(" ", "\r\n")), (8, text), (8, text), (9, text.upper())])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert drop_repeated_windows(empty, digest=True).collect() == []


def test_word_hashes_follow_words():
    raw = [b"", b" a  b\n", "é x a".encode(), b"a" * 70, b"a" * 134, b"A"]
    h, n = word_hashes(raw)
    words = [w for t in raw for w in t.split()]
    assert n.tolist() == [len(t.split()) for t in raw]
    assert len(set(h.tolist())) == len(set(words))
    assert (h[0] == h[3]) and word_hashes([b"A"], lower=True)[0][0] == h[0]
    assert np.array_equal(word_hashes([b"a b"])[0], h[:2])
