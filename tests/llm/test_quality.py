import math
import zlib

import numpy as np
import pytest

from pricewell.llm.quality_classifier import MEASURES, class_prior, classify, fit
from pricewell.llm.quality_rules import apply_rules, base_counts, clean_lines, line_fails


def slow_repeat(words, width=8):
    at = {}
    for i in range(len(words) - width + 1):
        at.setdefault(tuple(words[i : i + width]), []).append(i)
    hit = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + width)}
    return len(hit)


def test_base_counts_follow_their_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    some = 0
    for t in [r.text for r in docs] + ["a " * 50, "a b " * 9, "x", "", " \n ", "l\nl\n\nl#*", "é漢 é漢"]:
        w = [x for x in t.translate({c: 32 for c in range(9, 14)}).split(" ") if x]
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), slow_repeat(w))
        assert base_counts(t.encode()) == want
        some += want[4] > 0
    assert some > 5


def test_rules():
    assert line_fails(b"home | about | news | contact | help") == "navigation"
    assert line_fails(b"In.&&& Of%%% edorat$$$ ederhe$$$ reaan$$$.") == "punctuation"
    assert line_fails(b"BUY!! NOW!! CHEAP!! THINGS!! HERE!!") == "boilerplate"
    assert line_fails(b"All rights reserved.") == "boilerplate" and line_fails("Todos os direitos reservados.".encode()) == "boilerplate" and line_fails(b"Share on Facebook") == "boilerplate"
    assert line_fails(b"Home About Contact") == "navigation" and line_fails(b"Contact lenses") is None
    assert line_fails(b"The court held that the privacy policy of the company did not bind those who had never seen it.") is None
    assert line_fails(b"for k in range(10) {") is None
    assert line_fails(b"a line of words without an end") == "punctuation"
    assert line_fails(b"A sentence with its end.") is None and line_fails(b"Short title") is None and line_fails(b"  ") is None
    assert clean_lines(b"Good line one here.\nx | y | z | w | v\n\nGood.") == b"Good line one here.\n\nGood."


def test_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id: r.quality for r in labels.collect()}
    rows = {r.doc_id: r for r in apply_rules(docs).collect()}
    clean = [d for d, q in good.items() if q == 1 and not rows[d].base_failed]
    assert sum(rows[d].kept for d in clean) >= 0.98 * len(clean)
    assert sum(rows[d].kept for d, q in good.items() if q == 0) <= 0.05 * sum(q == 0 for q in good.values())


def test_rules_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Word and word here. " * 20_000), (4, "a b."), (4, "a b."), (None, "x")], "doc_id long, text string").selectExpr("*", "true AS kept")
    rows = apply_rules(docs, cleaned=True).collect()
    assert [r.base_failed for r in sorted(rows, key=lambda r: str(r.doc_id))] == [True] * 6 and len(rows) == 6
    assert apply_rules(docs.limit(0)).collect() == []


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = np.array([s for s, q in held if q]), np.array([s for s, q in held if not q])
    auc = np.mean([(good > b).mean() + 0.5 * (good == b).mean() for b in bad])
    assert auc > 0.97 and (good >= 0.3).mean() > 0.97 and (bad < 0.3).mean() > 0.7
    # rows that are held out, language and source teach nothing
    fewer = labels.filter("crc32(CAST(doc_id AS STRING)) % 5 <> 0").selectExpr("*", "'x' AS lang")
    again = {r.doc_id: r.score for r in classify(docs.withColumnRenamed("source", "quality"), fewer).collect()}
    assert again == {d: r.score for d, r in got.items()}


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Plain words in a row. " * 9), (3, "Plain words in a row. " * 9), (None, "x"), (5, "y " * 90_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (3, 1), (5, 0), (5, 1), (9, 1), (None, 1), (2, None)], "doc_id long, quality int")
    assert classify(docs, labels).count() == 6
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.5}
    assert classify(docs.limit(0), labels).collect() == []


def test_the_risk_is_not_driven_below_zero():
    rng = np.random.default_rng(1)
    p, n = rng.normal(1, 1, (300, len(MEASURES))), rng.normal(-1, 1, (300, len(MEASURES)))
    model = fit(p[:150], np.concatenate((p[150:], n[:150])), 0.5)
    assert (model.score(p) > 0.5).mean() > 0.9 and (model.score(n) < 0.5).mean() > 0.9


def test_a_cut_off_text_is_no_junk():
    assert line_fails(b"A whole sentence stands here. And then the text is cut") is None
    assert line_fails(b"Wher. Wher. Wher. Wher. Wher. Th Th Th Th Th.") == "boilerplate"


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
def test_the_prior_comes_from_positives_and_unlabelled(prior):
    rng = np.random.default_rng(int(prior * 10))
    good, bad = (lambda n: rng.normal(1, 1, (n, len(MEASURES)))), (lambda n: rng.normal(-1, 1, (n, len(MEASURES))))
    n = 3000
    mixed = np.concatenate((good(int(n * prior)), bad(n - int(n * prior))))[rng.permutation(n)]
    assert abs(class_prior(good(2000), mixed) - prior) < 0.06


def slow_risk(model, positive, unlabelled, prior, weights, bias, decay=0.1):
    """The non-negative risk by plain sums."""
    z = lambda x: float(np.dot(model.expand(x[None])[0], weights) + bias)
    loss = lambda s: math.log1p(math.exp(-s)) if s > -30 else -s
    plus = sum(loss(z(x)) for x in positive) / len(positive)
    minus = sum(loss(-z(x)) for x in unlabelled) / len(unlabelled) - prior * sum(loss(-z(x)) for x in positive) / len(positive)
    return prior * plus + max(0.0, minus) + decay * float(np.dot(weights, weights)) / 2


def test_the_fit_is_a_minimum_of_the_plain_risk():
    """No step in any of many directions lowers the risk that plain sums give by more than a hair."""
    rng = np.random.default_rng(2)
    p = rng.normal(0.3, 1, (150, len(MEASURES)))
    u = np.concatenate((rng.normal(0.3, 1, (150, len(MEASURES))), rng.normal(-0.3, 1, (150, len(MEASURES)))))
    model = fit(p, u, 0.5, steps=2000, rate=0.02, decay=0.1)
    best = slow_risk(model, p, u, 0.5, model.weights, model.bias)
    assert best < slow_risk(model, p, u, 0.5, np.zeros_like(model.weights), 0.0)
    for _ in range(25):
        d = rng.normal(size=len(model.weights) + 1)
        d /= np.linalg.norm(d)
        for size in (0.02, 0.2, 1.0):
            assert slow_risk(model, p, u, 0.5, model.weights + size * d[:-1], model.bias + size * d[-1]) > best - 2e-3
