import random
import re

import numpy as np
import pytest

from pricewell.llm.source_divergence import MOST, audit_sources, share, share_column

LOWER = {c: c + 32 for c in range(65, 91)}


def slow(rows, min_docs=3, top=200):
    """Python's whole numbers over plain dictionaries."""
    rows = [(a or "", b or "", c or "") for a, b, c in rows]
    docs, groups = {}, {}
    for lang, source, text in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        mine = groups.setdefault(lang, {}).setdefault(source, {})
        for w in words:
            mine[w] = mine.get(w, 0) + 1
        for w in set(words):
            docs.setdefault(lang, {})[w] = docs.get(lang, {}).get(w, 0) + 1
    out = []
    for lang, sources in groups.items():
        kept = [w for w, n in docs.get(lang, {}).items() if n >= min_docs]
        p = {}
        for source, c in sources.items():
            total = sum(c.get(w, 0) for w in kept) + len(kept)
            p[source] = {w: 1 + 10**9 * (c.get(w, 0) + 1) // total for w in kept}
        whole = {w: sum(c.get(w, 0) for c in sources.values()) for w in kept}
        q = {w: 1 + 10**9 * (whole[w] + 1) // (sum(whole.values()) + len(kept)) for w in kept}
        for source, c in sources.items():
            f = lambda a, b: (a - b) ** 2 // b
            pairs = [(t, sum(f(p[source][w], p[t][w]) for w in kept)) for t in sources if t != source]
            terms = [(w, f(p[source][w], q[w])) for w in kept if c.get(w, 0) > 0 and p[source][w] > q[w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("block", "chunk", "span"), [(16, 1 << 15, 4), (2, 7, 1), (1, 3, 2), (3, 1000, 1)])
def test_all_tilings_agree_with_whole_numbers(spark, block, chunk, span):
    r = random.Random(5)
    words = [f"w{chr(97 + k % 26)}{'é' * (k % 3)}{chr(97 + k // 26)}" for k in range(90)] + ["字", "É", "é", "ZZ"]
    rows = []
    for k in range(150):
        lang, source = r.choice(["en", "de", "", None]), r.choice([f"s{j}" for j in range(7)] + [None, "", "S"])
        text = " ".join(r.choice(words[: r.choice((5, 30, 94))]) + r.choice(["", ".", "1", "_"]) for _ in range(r.randint(0, 60)))
        rows.append((lang, "big" if r.random() < 0.3 else source, text if k % 11 else None))
    rows += [("once", "a", "rare words"), ("once", "b", ""), ("once", "c", None), ("lone", "x", "one one"), ("lone", "x", "one"), ("lone", "x", "one two")]
    docs = spark.createDataFrame([(*x, 1, "t") for x in rows], "lang string, source string, text string, n int, term string").repartition(6)
    want = slow(rows)
    assert got(audit_sources(docs, block=block, chunk_terms=chunk, span=span)) == want
    assert {x[0] for x in want} == {"", "de", "en", "once"} and ("once", "a", "pair", "b", 0, 1) in want


def test_documents_and_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert got(audit_sources(docs, top_terms=5, block=3, chunk_terms=100)) == slow(rows, top=5)
    assert got(audit_sources(docs.limit(0))) == []


def test_shares_are_exact_up_to_their_bound(spark):
    r = random.Random(2)
    pairs = [(0, 1), (MOST - 1, MOST), (0, MOST)] + [(r.randrange(t), t) for t in (r.randrange(1, MOST) for _ in range(500))]
    want = [1 + 10**9 * (c + 1) // t for c, t in pairs]
    count, total = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    assert share(count, total).tolist() == want
    frame = spark.createDataFrame([(k, *x) for k, x in enumerate(pairs)], "k int, c long, t long").select("k", share_column("c", "t").alias("p"))
    assert [x.p for x in sorted(frame.collect())] == want
    with pytest.raises(OverflowError):
        share(np.array([1]), np.array([MOST + 1]))
