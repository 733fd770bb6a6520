import hashlib
import random
import re
import time

import numpy as np
import pytest

from pricewell.llm import line_dedup
from pricewell.llm.line_dedup import LineIndex, PerfectHash, dedup_lines

EDGE = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")


def key(line):
    return EDGE.sub("", line).translate({c: c + 32 for c in range(65, 91)})


def slow(rows, min_chars=40, min_docs=5):
    held = {}
    for n, (d, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held.setdefault(k, []).append((d is not None, d or 0, n))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [len(held.get(key(x), [])) >= min_docs and max(held[key(x)])[:2] != (d is not None, d or 0) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((d, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("room", "hot"), [(32 << 20, 1024), (32 << 20, 10), (24 * 3, 10), (0, 10)])
def test_all_paths_agree_with_plain_counting(spark, room, hot):
    r = random.Random(room)
    shared = [f"shared line {k} " + "é" * 30 for k in range(12)]
    rows = []
    for d in range(80):
        lines = [r.choice(shared) if r.random() < 0.5 else f"own {d} {r.random()} " + "x" * 30 for _ in range(r.randint(0, 9))]
        rows.append((d, "\n".join(x.upper().replace("É", "é") if r.random() < 0.2 else "\t" + x + " \r" for x in lines)))
    docs = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, n_lines int")
    got = sorted((tuple(x) for x in dedup_lines(docs, broadcast_bytes=room, shard_keys=4, hot_docs=hot, digest=True).collect()), key=str)
    assert got == slow(rows)


def test_edge_cases(spark):
    line = "A line that is more than forty characters long."
    rows = [(1, None), (2, ""), (3, line), (4, line.lower()), (5, f" {line}\n{line}"), (6, "\n".join([line] * 3000)), (6, line), (None, line), (8, "x" * 39), (9, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for room in (32 << 20, 0):
        got = sorted((tuple(x) for x in dedup_lines(docs, broadcast_bytes=room, digest=True).collect()), key=str)
        assert got == slow(rows)
        assert dedup_lines(docs.limit(0), broadcast_bytes=room, digest=True).collect() == []
    kept = dedup_lines(docs.selectExpr("*", "'s' AS source", "1 AS n_dropped"))
    assert kept.columns == ["doc_id", "text", "source", "n_dropped", "n_lines"] and kept.count() == len(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    at = PerfectHash.build(keys)(keys)
    assert sorted(at.tolist()) == list(range(len(keys)))
    h2 = keys[::-1].copy()
    index = LineIndex.loads(LineIndex.build(keys, h2, np.arange(len(keys)), np.arange(len(keys))).dumps())
    found, counts, last = index.probe(keys, h2)
    assert found.all() and counts.tolist() == last.tolist() == list(range(len(keys)))
    assert not index.probe(keys, h2 + np.uint64(1))[0].any()


def test_shards_hold_every_distinct_line_and_decide(spark):
    """At default parameters the counts of the shards' arrays are what drops a line."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, []).append(d)
    small = docs.select("doc_id", "text")
    counted = line_dedup.per_batch(small, line_dedup._count(40), "h1 long, h2 long, n long, last long").groupBy("h1", "h2").agg({"n": "sum", "last": "max"}).toDF("h1", "h2", "last", "n").select("h1", "h2", "n", "last")
    shards = [LineIndex.loads(bytes(r.data)) for r in line_dedup.build_shards(counted, 5).collect()]
    assert len(shards) == 5 and sum(len(s.prints) for s in shards) == len(held)
    h = line_dedup._hashes([k.encode() for k in held])
    shard = np.mod(h[:, 0].view(np.int64), 5)
    by_number = {int(r.shard): LineIndex.loads(bytes(r.data)) for r in line_dedup.build_shards(counted, 5).collect()}
    for (k, ids), x, n in zip(held.items(), h, shard, strict=True):
        found, count, last = by_number[int(n)].probe(x[:1], x[1:])
        assert found[0] and count[0] == len(ids) and last[0] == max(ids), k
    assert max(map(len, held.values())) < 1024, "no line is hot here, so shards decide alone"
    got = sorted((tuple(x) for x in dedup_lines(docs, digest=True).collect()), key=str)
    assert got == slow(rows) and sum(x[2] for x in got) > 0


def test_repeated_ids_count_as_rows(spark):
    line = "One line of at least forty characters, five times."
    rows = [(7, line)] * 5 + [(3, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(x) for x in dedup_lines(docs, digest=True).collect()), key=str) == slow(rows)


def test_rows_without_an_id_take_time_in_proportion(spark):
    """Fifty long lines each, in groups of 500 texts with the same lines, one of which has an id: no row gets the hits of all others."""
    line = "concat('group ', id div 500, ' line ', k, ' of a text that is long enough', if(k = 0, cast(id as string), ''))"
    made = lambda n: spark.range(n).selectExpr("if(id % 500 = 0, id, NULL) AS doc_id", f"array_join(transform(sequence(0, 49), k -> {line}), '\\n') AS text").repartition(8)
    took = {}
    for n in (2000, 2000, 20_000):
        began = time.time()
        got = dedup_lines(made(n), digest=True).agg({"n_dropped": "sum", "n_lines": "sum"}).first()
        took[n] = time.time() - began
        assert (got["sum(n_lines)"], got["sum(n_dropped)"]) == (50 * n, 49 * (n - n // 500))
    assert took[20_000] < 12 * max(took[2000], 2)
