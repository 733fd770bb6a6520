import hashlib
import random

import numpy as np
import pytest

from pricewell.llm.fill_middle import Automaton, compose, fill_middle, lanes_of, restore, scan


def slow(doc_id, text):
    """Straight from the definition, over code points."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, out = "plain", text
    elif h4 % 100 < 20:
        form, out = "spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    else:
        form, out = "psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, *((None, None) if form == "plain" else (a, b - a)), sha(out), sha(text))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed, n=120):
    r = random.Random(seed)
    letters = ["a", " ", "\n", "é", "€", "𝄞", "<", "<P", "S>", "<M", "́", "字"]
    rows = [(k, "".join(r.choice(letters) for _ in range(r.randint(0, r.choice((3, 40, 700, 5000)))))) for k in range(n)]
    return [(k, t.replace("<P>", "").replace("<S>", "") if k % 3 else t) for k, t in rows]


@pytest.mark.parametrize("giant", [1 << 16, 300, 7])
def test_every_text_equals_the_definition(spark, giant):
    rows = made(giant) + [(None, "no id " * 100), (5, None), (6, ""), (7, "x" * 2000), (7, "x" * 2000), (8, "<M>"), (9, "é" * 600)]
    docs = spark.createDataFrame([(*x, "z", 1) for x in rows], "doc_id int, text string, form string, n int").repartition(5)
    assert rows_of(fill_middle(docs, giant_bytes=giant, digest=True)) == sorted((slow(*x) for x in rows), key=str)
    assert fill_middle(docs.limit(0), giant_bytes=giant, digest=True).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted((slow(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert rows_of(fill_middle(docs, digest=True)) == want
    assert rows_of(fill_middle(docs, giant_bytes=2000, digest=True)) == want


def test_one_text_over_many_parts(spark):
    text = "".join(random.Random(1).choice("abcé€𝄞 <") for _ in range(400_000))
    docs = spark.createDataFrame([(k, text) for k in range(4)], "doc_id long, text string")
    for r in fill_middle(docs, giant_bytes=4096).collect():
        assert hashlib.sha256(r.output.encode()).hexdigest() == slow(r.doc_id, text)[5]


def test_functions_compose_to_the_whole_scan():
    """Functions of chunks, cut anywhere, give what one walk from the start gives, for each state of entry."""
    auto = Automaton()
    r = random.Random(3)
    raw = "".join(r.choice(["<", "P", ">", "é", "𝄞", "x", "<S>"]) for _ in range(3000)).encode()
    for width in (1, 5, 64, 512):
        data, length, text = lanes_of([raw], width)
        end, units, marks = auto.functions(data, length)
        for start in range(auto.size):
            state, n, m = start, 0, 0
            for k in range(len(length)):
                n, m, state = n + int(units[k, state]), m + int(marks[k, state]), int(end[k, state])
            s, n2, m2 = start, 0, 0
            for b in raw:
                n2, m2, s = n2 + int(auto.begins[s, b]), m2 + int(auto.ends[s, b]), int(auto.step[s, b])
            assert (state, n, m) == (s, n2, m2)
        entry = auto.entry_states(end, text)
        walk = [auto.start]
        for k in range(len(length) - 1):
            walk.append(int(end[k, walk[-1]]))
        assert entry.tolist() == walk


def test_cuts_at_lines(spark):
    texts = ["one\ntwo\n\nfour é", "", "\n\n", "x", "a\n"]
    n, _, cut = scan(Automaton("line"), [t.encode() for t in texts], 3)
    for k, t in enumerate(texts):
        lines = t.encode().splitlines(keepends=True)
        assert n[k] == len(lines)
        assert [cut(k, i) for i in range(len(lines) + 1)] == np.cumsum([0, *map(len, lines)]).tolist()
    docs = spark.createDataFrame([(k, f"line {k}\nsecond\nthird é\n" * 50) for k in range(30)], "doc_id long, text string")
    for limit in (1 << 16, 64):
        for r in fill_middle(docs, unit="line", giant_bytes=limit).collect():
            text = f"line {r.doc_id}\nsecond\nthird é\n" * 50
            assert r.n == 150 and restore(r.output.encode(), r.form) == text.encode()
            if r.form != "plain":
                lines = text.encode().splitlines(keepends=True)
                a = len(b"".join(lines[: r.prefix_chars]))
                b = a + len(b"".join(lines[r.prefix_chars : r.prefix_chars + r.middle_chars]))
                assert r.output.encode() == compose(text.encode(), r.form, a, b)
