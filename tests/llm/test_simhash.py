import re

import numpy as np
import pytest
import xxhash

from pricewell.llm import simhash
from pricewell.llm.simhash import allocate, near_groups

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_print(text, words=3):
    w = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    sh = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(rows, radius=3):
    fps = [slow_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))), key=str)


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in near_groups(docs).collect()), key=str)
    assert got == slow_groups(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "One"), (6, "two words"), (7, "x" * 100_000), (7, "x" * 100_000), (None, "one"), (9, "É é ﬁ x y z")]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, fp string, component_id string")
    got = sorted((tuple(r) for r in near_groups(docs).collect()), key=str)
    assert got == slow_groups(rows)
    assert near_groups(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n", [100, 10**6, 10**12])
def test_thresholds_add_up(n):
    both = np.full((64, 64), n // 4)
    np.fill_diagonal(both, n // 2)
    plan = allocate(n, both, 3)
    assert sum(t + 1 for _, t in plan) == 4
    bits = [b for g, _ in plan for b in g]
    assert len(bits) == len(set(bits))


@pytest.mark.parametrize("t", [[0, 0, 0, 0], [1, 1], [3], [2, 0]])
def test_any_allocation_finds_all_links(spark, t, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for k in range(1, 6):
            fps.add(int(b) ^ sum(1 << int(x) for x in rng.choice(64, k, replace=False)))
    fps = np.array(sorted(fps), np.uint64)
    prints = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    cut = 64 // len(t)
    plan = [(list(range(k * cut, (k + 1) * cut)), x) for k, x in enumerate(t)]
    monkeypatch.setattr(simhash, "LARGE_BUCKET", 8)
    rows = simhash.keyed(prints, plan).repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(simhash._buckets(3), "a long, b long").collect()

    def parts(edges):
        root = {int(x): int(x) for x in fps.view(np.int64)}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {x: find(x) for x in root}

    signed = fps.view(np.int64)
    true = [(int(signed[i]), int(signed[j])) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3]
    assert parts([(r.a, r.b) for r in rows]) == parts(true)
