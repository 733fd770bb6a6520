import numpy as np
import random
import re

from pricewell.llm.decontaminate import Items, drop_contaminated, find_items


def shingles(t):
    w = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow(docs, items, least=0.8):
    out = []
    sets = [(i, shingles(t)) for i, t in items]
    for d, t in docs:
        own = shingles(t)
        for i, s in sets:
            if s and len(s & own) >= least * len(s):
                out.append((d, i, len(s), len(s & own) / len(s)))
    return sorted(out, key=str)


def test_whole_small_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = slow([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want
    assert sorted((tuple(r) for r in find_items(docs, items).collect()), key=str) == want
    assert sorted((tuple(r) for r in find_items(docs, items, block_bytes=2000).collect()), key=str) == want
    bad = {d for d, *_ in want}
    assert {r.doc_id for r in drop_contaminated(docs, items).collect()} == {r.doc_id for r in docs.collect()} - bad


def test_edited_passages_in_long_documents(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(r.choice((5, 7, 12, 20, 45, 90, 300))))) for i in range(60)]
    docs = []
    for d in range(120):
        w = items[d % 60][1].split()
        for _ in range(len(w) // 60):
            w[r.randrange(len(w))] = word()
        text = [word() for _ in range(r.choice((0, 10, 3000)))] + w + [word() for _ in range(r.choice((0, 10, 3000)))]
        docs.append((d, r.choice((" ", "\n", ", ")).join(x.upper() if d % 3 == 0 else x for x in text)))
    a, b = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    want = slow(docs, items)
    assert len(want) > 90
    assert sorted((tuple(x) for x in find_items(a, b).collect()), key=str) == want


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "one two"), (4, "One, two!"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f g")]
    items = [(1, None), (2, ""), (3, "one two"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "x y z u v w")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(x) for x in find_items(a, b).collect()), key=str) == slow(docs, items)
    assert find_items(a.limit(0), b).collect() == [] and find_items(a, b.limit(0)).collect() == []
    assert drop_contaminated(a, b.limit(0)).count() == 7


def test_repetitive_items_stretch_no_blocks(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    normal = [(i, " ".join(word() for _ in range(r.choice((27, 28, 30, 31, 32))))) for i in range(60)]
    again = []
    for i in range(60, 70):
        few = [word() for _ in range(30)]
        again.append((i, " ".join(few * 20) if i % 2 else " ".join(w for w in few for _ in range(8))))
    items, docs = normal + again, []
    for d in range(210):
        w = items[d % 70][1].split()
        if d % 3:
            w[len(w) // 8] = word()
        docs.append((d, " ".join([word() for _ in range(3000)] + w + [word() for _ in range(3000)])))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = slow(docs, items)
    assert len(want) > 150 and len([x for x in want if x[1] >= 60]) >= 20
    assert sorted((tuple(x) for x in find_items(a, b).collect()), key=str) == want
    assert {x.doc_id for x in drop_contaminated(a, b).collect()} == {d for d, _ in docs} - {x[0] for x in want}


def test_scattered_shingles_of_a_long_document_count(spark):
    """Pieces of an item far apart in a long document: no block holds enough of it, the whole document does."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    item = [word() for _ in range(60)]
    text = []
    for k in range(0, 60, 12):
        text += item[max(0, k - 4) : k + 12] + [word() for _ in range(900)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(word() for _ in range(5000)))], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(item)), (6, " ".join(word() for _ in range(60)))], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.containment) for r in find_items(docs, items).collect()]
    assert got == [(1, 5, 1.0)]


def test_blocks_and_index_each_find_what_is_theirs(spark):
    """Without the minimum hashes all pairs are lost but one that lies scattered; without the index no other."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    spread = [word() for _ in range(60)]
    docs.append((-1, " ".join(w for k in range(0, 60, 12) for w in spread[max(0, k - 4) : k + 12] + [word() for _ in range(900)])))
    items.append((-1, " ".join(spread)))
    want = {(d, i) for d, i, *_ in slow(docs, items)}
    held, raw = Items([i for i, _ in items], [(t or "").encode() for _, t in items]), [(t or "").encode() for _, t in docs]
    told = lambda: {(docs[d][0], held.ids[i]) for d, i, *_ in held.matches(raw, 0.8)}
    assert told() == want and len(want) > 20
    candidates, counted = held.candidates, held.counted
    held.candidates = lambda h, count: set()
    assert told() == {(-1, -1)}, "what blocks show comes from the minimum hashes alone"
    held.candidates, held.counted = candidates, lambda h, count, least: set()
    assert want - {(-1, -1)} <= told() <= want
    held.counted = counted


def test_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7, "x", 0.5), (2, "g h i j k l", 8, "y", None)], "doc_id long, text string, item_id int, n_shingles string, containment double")
    items = spark.createDataFrame([(5, "a b c d e f", "z")], "item_id long, text string, doc_id string")
    assert [tuple(r) for r in find_items(docs, items).collect()] == [(1, 5, 2, 1.0)]
    assert [tuple(r) for r in drop_contaminated(docs, items).collect()] == [(2, "g h i j k l", 8, "y", None)]
