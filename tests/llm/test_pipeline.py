import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pricewell.llm import simhash
from pricewell.llm.simhash import drop_near_duplicates, near_duplicates, similarity


def slow_pairs(rows, least=0.8):
    return {(a, b) for n, (b, y) in enumerate(rows) for a, x in rows[:n] if similarity(x.encode(), y.encode(), 5) >= least}


def test_near_copies_are_found_and_others_stay(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    rows = []
    for g in range(15):
        base = [word() for _ in range(200)]
        for c in range(4):
            w = list(base)
            for k in rng.choice(200, c, replace=False):
                w[k] = word()
            rows.append((g * 10 + c, " ".join(w)))
    rows += [(1000 + k, " ".join(word() for _ in range(60))) for k in range(40)] + [(2000, "same"), (2001, "same"), (2002, ""), (2003, "")]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(rows, slow_pairs(rows))


def test_near_duplicates_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 0), (None, "a b", 0), (4, "x y z " * 20_000, 0), (5, " \n ", 0), (None, "lone", 0)], "doc_id long, text string, node int")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (None, 3), (4, 4), (5, 1), (None, None)], key=str)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, None]
    assert near_duplicates(docs.limit(0)).collect() == [] and drop_near_duplicates(docs.limit(0)).collect() == []


def test_two_texts_under_one_id_both_stay(spark):
    rows = [(7, "one text about the sea and its ships", "a"), (7, "another text on quite other things at all", "b"), (8, "one text about the sea and its ships", "c"), (6, "a third one that stands alone here", "d")]
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.source) for r in kept) == [(6, "d"), (7, "a"), (7, "b")]


def test_all_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    sizes, now = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, "/root/testdata/sf0.01").persist()
        sizes.append(after.count())
        if name != "sentencepiece":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
            assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in now.select("doc_id").collect()}
        if name == "quality_classifier":
            kept = {r.doc_id for r in after.select("doc_id").collect()}
            assert sum(d in kept for d, q in labels.items() if q) > 0.97 * sum(labels.values())
        if name == "line_dedup":
            assert sizes[-1] == sizes[-2]
        if name == "simhash_near_dedup":
            texts = [r.text for r in after.select("text").collect()]
            assert len(texts) == len(set(texts))
        now = after
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 500
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.01").count() == sizes[-1]


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").collect() == []


def test_repeated_rows_and_rows_without_id(spark):
    text = "Some words that stand in a row and end here. " * 5
    docs = spark.createDataFrame([(3, text, "en", "s", 1), (3, text, "en", "s", 1), (4, text, "en", "s", 1), (None, text, "en", "s", 1), (5, None, None, None, None), (None, "Quite another text than the one that all the others have here. " * 3, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id for r in got), key=str) == [3, 5, None]
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "/root/testdata/sf0.001").collect()


def linked(rows, links):
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {d: find(d) for d in root}


def edited_groups(seed=8, groups=6, copies=24, size=240):
    """Chains and stars of edited copies whose similarities lie about 0.7 to 0.95."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    rows = []
    for g in range(groups):
        made = [[word() for _ in range(size)]]
        for c in range(1, copies):
            w = list(made[-1 if g % 2 else 0])
            for k in rng.choice(size, int(rng.integers(1, 8)), replace=False):
                w[k] = word()
            made.append(w)
        rows += [(g * 1000 + c, " ".join(w)) for c, w in enumerate(made)]
    return rows


def test_groups_equal_brute_force(spark):
    rows = edited_groups()
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(rows, slow_pairs(rows))


def test_large_buckets_are_split_without_losing_pairs(spark):
    rows = edited_groups(seed=5, groups=4, copies=40)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), large=6).collect()}
    assert got == linked(rows, slow_pairs(rows))


@pytest.mark.parametrize("changed", [8])
def test_pairs_at_the_threshold_are_found(spark, changed):
    """Lone pairs of similarity 0.8 to 0.9, most of whose fingerprints are more than three bits apart."""
    rng = np.random.default_rng(changed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows = []
    for g in range(120):
        w = [word() for _ in range(400)]
        v = list(w)
        for k in rng.choice(400, changed, replace=False):
            v[k] = word()
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(v))]
    want = {(a, b) for (a, x), (b, y) in zip(rows[::2], rows[1::2], strict=True) if similarity(x.encode(), y.encode(), 5) >= 0.8}
    assert len(want) > 90
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(a, b) for a, b in want if got[a] == got[b]} == want
    prints = simhash.sketches([x.encode() for _, x in rows], 5)[0]
    assert sum(int(prints[a] ^ prints[b]).bit_count() > 3 for a, b in want) > len(want) / 2


def batches(fp, groups, cell=-1, side=2):
    n = len(fp)
    one = lambda x, kind: pa.array(np.full(n, x), kind)
    whole = pa.RecordBatch.from_arrays([one(0, pa.int32()), one(0, pa.int64()), one(cell, pa.int32()), one(side, pa.int32()), pa.array(fp.view(np.int64)), one(9, pa.int64()), pa.array(np.arange(n)), pa.array(groups)], list(simhash.ROW))
    return [whole.slice(k, 50) for k in range(0, n, 50)]


def test_a_hot_bucket_takes_linear_work_until_it_is_split():
    n = 20_000
    fp = np.zeros(n, np.uint64)  # texts that differ and share a fingerprint
    out = [(k, a, b) for x in simhash._candidates([11], [simhash._mask(list(range(32)))], 0.8, 1, 2048, rows=1000)(iter(batches(fp, np.arange(n)))) for k, a, b in zip(*(x.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True)]
    assert {(a, b) for k, a, b in out if k == simhash.PAIR} == {(k, k + 1) for k in range(n - 1)}
    assert {a for k, a, _ in out if k == simhash.MORE} == set(range(n))
    assert {(a, b) for k, a, b in out if k == simhash.LARGE} == {(0, 0)}


def test_cells_hold_every_pair_of_different_groups(spark):
    n = 200
    group = lambda k: 0 if k < 120 else k
    rows = spark.createDataFrame([(p, 7, k, 1, k, 0 if p else group(k)) for k in range(n) for p in (0, 1)], "part int, key long, fp long, size long, node long, grp long")
    hot = spark.createDataFrame([(0, 7), (1, 7)], "part int, key long")
    got = simhash.split(rows, hot, simhash.Scratch(spark, "cells"), "cells", 16).collect()
    cells = {}
    for r in got:
        cells.setdefault(r.cell, ([], []))[r.side].append(r.node)
    assert {r.part for r in got} == {0}, "a bucket of one group has nothing to try"
    assert max(len(x) for c in cells.values() for x in c) < 48 and len(cells) == 65
    met = {(min(a, b), max(a, b)) for zero, one in cells.values() for a in zero for b in one if group(a) != group(b)}
    assert met == {(a, b) for b in range(n) for a in range(b) if group(a) != group(b)}


def test_stage_rows_equal_plain_python(spark):
    """Line, near-copy, benchmark and piece stages row for row, each over what the stage before has kept."""
    from pricewell.llm.sentencepiece_codec import MODEL_PATH
    from test_decontaminate import slow as slow_items
    from test_line_dedup import key

    sf = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: sorted((tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=str)
    start = stages["quality_classifier"](spark, docs, sf).persist()
    now = rows(start)
    held = {}
    for d, t, *_ in now:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, []).append(d)
    often = {k: max(ids) for k, ids in held.items() if len(k) >= 40 and len(ids) >= 5}
    lines = [(d, t, "\n".join(x for x in (t or "").split("\n") if often.get(key(x), d) == d), lang, s) for d, t, lang, s, _ in now]
    after = stages["line_dedup"](spark, start, sf).persist()
    assert rows(after) == sorted(((d, t, lang, s, len(t)) for d, _, t, lang, s in lines), key=str)
    near = stages["simhash_near_dedup"](spark, after, sf).persist()
    texts = [(d, t) for d, t, *_ in rows(after)]
    group = linked(texts, slow_pairs(texts))
    assert {d for d, *_ in rows(near)} == set(group.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = stages["benchmark_decontamination"](spark, near, sf).persist()
    bad = {d for d, *_ in slow_items([x[:2] for x in rows(near)], items)}
    assert bad and rows(clean) == [x for x in rows(near) if x[0] not in bad]
    spm = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL_PATH)
    told = {d: t for d, t, *_ in rows(clean)}
    got = stages["sentencepiece"](spark, clean, sf).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {d: spm.encode(t or "") for d, t in told.items()}


def test_stages_take_extra_columns_of_clashing_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = docs.selectExpr("*", "1 AS n_lines", "'h' AS hits", "doc_id AS item_id", "2.5 AS score", "0 AS predicted", "'n' AS node", "array(1) AS ids", "0 AS _id", "0 AS _h1")
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, more, "/root/testdata/sf0.001")
        assert got.columns == list(corpus_pipeline.COLUMNS), name
        assert got.count() == stage(spark, docs, "/root/testdata/sf0.001").count()
    assert corpus_pipeline.sentencepiece(spark, more, "").count() == docs.count()
