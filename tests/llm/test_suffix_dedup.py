import hashlib
import random

import numpy as np
import pytest

from pricewell.llm import repeats, substring_dedup, suffix_dedup
from pricewell.llm.repeats import exchange
from pricewell.llm.suffix_dedup import common_prefixes, drop_repeated_strings, sort_suffixes


def slow(rows, width=50):
    least, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            k = b[i : i + width]
            v = (d is not None, d or 0)
            least[k] = min(least.get(k, v), v)
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if least[b[i : i + width]] < (d is not None, d or 0):
                gone[i : i + width] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def same(spark, rows):
    docs = spark.createDataFrame([(*r, b"x", 1) for r in rows], "doc_id long, text string, found binary, n_bytes int")
    got = sorted((tuple(r) for r in drop_repeated_strings(docs, digest=True).collect()), key=str)
    assert got == slow(rows)


@pytest.mark.parametrize(("n", "letters"), [(1, 2), (2, 1), (700, 1), (1500, 2), (1500, 3), (2000, 256)])
def test_two_stage_order(n, letters):
    t = np.random.default_rng(n).integers(0, letters, n).astype(np.uint8)
    order, b = sort_suffixes(t, 50), t.tobytes()
    assert sorted(order.tolist()) == list(range(n))
    keys = [b[i : i + 50] for i in order]
    assert keys == sorted(keys)
    for x, y, p in zip(keys, keys[1:], common_prefixes(t, order, 50)[1:], strict=False):
        while p < 50 and p < min(len(x), len(y)):
            assert x[:p] == y[:p] and x[p] != y[p]
            break


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in drop_repeated_strings(docs, digest=True).collect()), key=str)
    assert got == slow(rows)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aé漢 \n"])
def test_random_pieces(spark, letters):
    r = random.Random(len(letters))
    pieces = ["".join(r.choice(letters) for _ in range(r.randint(30, 200))) for _ in range(8)] + ["a" * 120, "ab" * 60]
    rows = []
    for d in range(60):
        text = "".join(r.choice(pieces) if r.random() < 0.5 else "".join(r.choice(letters) for _ in range(r.randint(1, 80))) for _ in range(r.randint(0, 5)))
        rows.append((d, text))
    r.shuffle(rows)
    same(spark, rows)


def test_edge_cases(spark):
    t = "".join(chr(97 + (i * i) % 23) for i in range(80))
    same(spark, [(1, None), (2, ""), (3, "short"), (4, t), (5, t), (5, t), (None, t), (6, t[:49]), (7, t[30:] + t), (8, "é" * 60), (9, "é" * 61), (10, "x" * 50_000), (11, "x" * 50_001)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert drop_repeated_strings(empty, digest=True).collect() == []


@pytest.mark.parametrize("module", [suffix_dedup, substring_dedup])
def test_a_slice_has_one_pack_a_partition(spark, monkeypatch, module):
    """Packs grow as slices times partitions, so there are no more of them than that."""
    seen = []

    def counted(sent, *args, **kwargs):
        seen.append({r.kind: r["count"] for r in sent.groupBy("kind").count().collect()})
        return exchange(sent, *args, **kwargs)

    for m in (module, repeats):
        monkeypatch.setattr(m, "exchange", counted)
    parts = repeats.partitions(spark)
    r = random.Random(5)
    rows = [(d, " ".join(str(r.random()) for _ in range(400))) for d in range(30)]
    docs = spark.createDataFrame(rows + [(d + 50, t) for d, t in rows], "doc_id long, text string").coalesce(1)
    if module is suffix_dedup:
        drop_repeated_strings(docs, digest=True).count()
    else:
        substring_dedup.drop_repeated_windows(docs, digest=True).count()
    assert 0 < seen[0][repeats.SENT] <= parts
    assert 0 < seen[1][repeats.SENT] <= parts * parts  # the documents come from as many tasks as partitions, a slice each


def test_packs_open_as_they_were():
    r = np.random.default_rng(3)
    d, h = r.integers(-(2**63), 2**63 - 1, (2, 40))
    doc = np.sort(r.integers(0, 40, 900))
    pos, more = r.integers(0, 2**31 - 1, (2, 900))
    shard, flag, name = r.integers(0, 7, 900).astype(np.int32), r.integers(0, 2, 900).astype(np.uint8), r.integers(0, 2**63, 900).astype(np.uint64)
    rows = np.bincount(shard, minlength=7)
    table = r.integers(0, 2**32, 900).astype(np.uint32)
    batch = next(repeats.packs(shard, repeats.SENT, doc, d, h, [pos, more], [flag], [name], [(rows, [table], [])]))
    e = repeats.unpack(batch.to_pylist(), 2, [np.uint8], [np.uint64], [([np.uint32], [])])
    order = np.argsort(shard, kind="stable")
    for got, want in ((e.d[e.doc], d[doc]), (e.h[e.doc], h[doc]), (e.pos, pos), (e.steps[1], more), (e.columns[0], flag), (e.plain[0], name)):
        assert got.tolist() == want[order].tolist()
    assert e.tables[0][0].tolist() == table.tolist()
    assert e.first[0].tolist() == np.repeat(np.cumsum(rows) - rows, rows).tolist()


def test_many_slices_and_sorts(spark, monkeypatch):
    """Stretches that are sorted some at a time give the classes that all of them give."""
    monkeypatch.setattr(suffix_dedup, "SORTED", 300)
    monkeypatch.setattr(suffix_dedup, "SLICE", 2000)
    r = random.Random(9)
    pieces = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(60, 160))) for _ in range(12)]
    same(spark, [(d, "".join(r.choice(pieces)[r.randint(0, 9) :] + str(r.randint(0, 99)) for _ in range(6))) for d in range(80)])
