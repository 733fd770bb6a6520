"""Finds, slugs, run results and searches against one-by-one versions in plain Python."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pricewell.operators import lifecycle
from pricewell.operators.basket import best_offers, list_baskets
from pricewell.operators.joins import text_matches
from pricewell.operators.keyed import components, unique_slugs
from pricewell.operators.token_index import matching_texts

T0 = datetime(2024, 6, 10)
FLYER = "id string, supermarket_id string, source_id string, store_ids array<string>, title string, original_url string, external_id string, valid_from timestamp, valid_until timestamp, status string, page_urls array<string>, storage_id string, created_at timestamp, updated_at timestamp"
FOUND = "supermarket_id string, source_id string, title string, original_url string, external_id string, page_urls array<string>, valid_from timestamp, valid_until timestamp, store_ids array<string>, found_at int"


def one_by_one(flyers, found):
    out = [dict(f) for f in flyers]
    for f in sorted(found, key=lambda f: f["found_at"]):
        mine = sorted((r for r in out if r["supermarket_id"] == f["supermarket_id"]), key=lambda r: (r["created_at"], r["id"]))
        mine = [r for r in mine if not r.get("new")] + [r for r in mine if r.get("new")]
        hit = next((r for r in mine if r["original_url"] == f["original_url"]), None) or next((r for r in mine if f["external_id"] and r["external_id"] == f["external_id"]), None)
        if hit is None:
            out.append({"id": f"new{len(out):03}", "new": True, "supermarket_id": f["supermarket_id"], "title": f["title"], "original_url": f["original_url"], "external_id": f["external_id"], "status": "discovered", "storage_id": None, "created_at": T0})
            continue
        if f["page_urls"] and not hit["storage_id"] and hit["status"] not in ("processing", "expired"):
            hit["status"] = "discovered"
        for c in ("title", "original_url", "external_id"):
            hit[c] = f[c] or hit[c]
    return sorted((r["supermarket_id"], r["title"] or "", r["original_url"], r["external_id"] or "", r["status"]) for r in out)


@pytest.mark.parametrize("seed", range(3))
def test_finds_are_matched_one_after_the_other(spark, seed):
    r = random.Random(seed)
    markets, urls, exts = ["m1", "m2"], [f"u{k}" for k in range(12)], [f"e{k}" for k in range(8)]
    flyers = [{"id": f"f{k:02}", "supermarket_id": r.choice(markets), "title": f"t{k}", "original_url": r.choice(urls), "external_id": r.choice([*exts, None, None]), "status": r.choice(["processed", "expired", "processing"]), "storage_id": r.choice(["s", None]), "created_at": T0 - timedelta(days=30 - k)} for k in range(12)]
    found = [{"supermarket_id": r.choice(markets), "source_id": "s", "title": r.choice([None, f"n{k}"]), "original_url": r.choice(urls), "external_id": r.choice([*exts, None]), "page_urls": r.choice([None, [], ["p"]]), "valid_from": None, "valid_until": None, "store_ids": None, "found_at": k} for k in range(25)]
    f = spark.createDataFrame([[x.get(c.split()[0]) for c in FLYER.split(", ")] for x in flyers], FLYER)
    g = spark.createDataFrame([[x[c.split()[0]] for c in FOUND.split(", ")] for x in found], FOUND).repartition(4)
    rows = lifecycle.discover(f, g, F.lit("2024-06-10").cast("timestamp")).collect()
    got = sorted((x.supermarket_id, x.title or "", x.original_url, x.external_id or "", x.status) for x in rows)
    assert got == one_by_one(flyers, found)
    assert len({x.id for x in rows}) == len(rows)
    assert sorted(tuple(x)[:6] for x in lifecycle.discover(f, g.limit(0), F.current_timestamp()).select("id", "title", "status", "original_url", "external_id", "storage_id").collect()) == sorted((x["id"], x["title"], x["status"], x["original_url"], x["external_id"], x["storage_id"]) for x in flyers)


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(f"n{k:03}", key) for k in range(40) for key in (f"k{k}", f"k{k + 1}")] + [(f"z{k:03}", "hub") for k in range(200)] + [("alone", "a")]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "node string, key string")).collect()}
    assert {got[f"n{k:03}"] for k in range(40)} == {"n000"} and {got[f"z{k:03}"] for k in range(200)} == {"z000"} and got["alone"] == "alone"


def slugs(rows, taken):
    used, out = set(taken), {}
    for scope, key, base in sorted(rows, key=lambda x: x[1]):
        s = next(s for s in itertools.chain([base], (f"{base}-{n}" for n in itertools.count(1))) if (scope, s) not in used)
        used.add((scope, s))
        out[key] = s
    return out


@pytest.mark.parametrize("seed", range(3))
def test_slugs_are_the_first_free_ones(spark, seed):
    r = random.Random(seed)
    bases = ["a", "a-1", "a-2", "a-1-1", "b", "c", "c-0", "d-9", ""]
    rows = [(r.choice("xy"), k, r.choice(bases if k < 120 else ["b", "c", "d"])) for k in range(200)]
    taken = {(r.choice("xy"), r.choice([*bases, "b-1", "b-3", "b-4", "c-1", "d", "d-1"])) for _ in range(12)}
    frame = spark.createDataFrame(rows, "market string, k int, base string").repartition(5)
    got = {x.k: x.slug for x in unique_slugs(frame, "base", ["k"], spark.createDataFrame(sorted(taken), "market string, slug string"), ("market",)).collect()}
    assert got == slugs(rows, taken)


def test_slugs_of_the_probe(spark):
    rows = [("m", 1, "a-b"), ("m", 2, "a-b"), ("m", 3, "a-b-1")]
    frame = spark.createDataFrame(rows, "market string, k int, base string")
    assert {x.k: x.slug for x in unique_slugs(frame.drop("market"), "base", ["k"]).collect()} == {1: "a-b", 2: "a-b-1", 3: "a-b-1-1"}
    assert unique_slugs(frame.limit(0), "base", ["k"]).collect() == []


def test_run_results_one_after_the_other(spark):
    r = random.Random(1)
    flows = [(f"f{k}", f"m{k % 3}", r.choice(["active", "active", "error", "draft"]), r.choice([None, T0]), None, r.choice([None, 0, 2, 3])) for k in range(20)]
    results = [(f"f{r.randrange(24)}", T0 + timedelta(minutes=k), r.choice([True, False, False]), r.choice([0, 2, None]), r.choice([None, "HTTP 500", "SCOPE_NOT_FOUND: x"]) if k % 3 else None) for k in range(300)]
    state, errors = {f[0]: {"status": f[2], "tries": f[5] or 0, "next": f[3], "last": None, "had": f[5]} for f in flows}, []
    for i, at, ok, new, error in results:
        if i not in state:
            continue
        s = state[i]
        s["last"] = at
        if ok:
            s["tries"] = 0
            s["next"] = s["next"] if new else at + timedelta(hours=6)
        elif "SCOPE_NOT_FOUND" in (error or ""):
            if s["status"] != "error":
                errors.append((i, error))
            s |= {"tries": 4, "status": "error"}
        else:
            s["tries"] += 1
            s["next"] = at + timedelta(hours=min(8, 2 ** (s["tries"] - 1)))
            if s["tries"] >= 4:
                s["status"] = "error"
                errors.append((i, error or f"Discovery failed after {s['tries']} attempts"))
    f = spark.createDataFrame(flows, "id string, supermarket_id string, status string, next_run_at timestamp, last_run_at timestamp, discovery_attempts int")
    after, rows = lifecycle.record_runs(f, spark.createDataFrame(results, "id string, at timestamp, ok boolean, new_flyers int, error string").repartition(4))
    seen = {x[0] for x in results}
    assert sorted((x.id, x.status, x.discovery_attempts, x.next_run_at, x.last_run_at) for x in after.collect()) == sorted((i, s["status"], s["tries"] if i in seen else s["had"], s["next"], s["last"]) for i, s in state.items())
    assert sorted((x.id, x.message) for x in rows.collect()) == sorted(errors)


WORDS = ["leite", "integral", "desnatado", "pão", "de", "forma", "azul", "bolacha", "ação", "água", "gás", "x"]


def test_texts_that_hold_all_tokens(spark):
    r = random.Random(3)
    texts = sorted({" ".join(r.choice(WORDS) for _ in range(r.randint(1, 5))).translate(str.maketrans("ãçáõ", "acao")) for _ in range(150)})
    keys = sorted({" ".join(sorted({w[(i := r.randrange(len(w))) : i + r.randint(2, 5)] for w in r.choices(WORDS, k=r.randint(1, 3))} - {w for w in "abcdefghijklmnopqrstuvwxyz"})).translate(str.maketrans("ãçáõ", "acao")) for _ in range(150)})
    keys = [" ".join(sorted({t for t in k.split() if len(t) >= 2})) for k in keys]
    got = {(x.key, x.text) for x in matching_texts(spark.createDataFrame([(k,) for k in sorted(set(keys))], "key string"), spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == {(k, t) for k in keys if k for t in texts if all(x in t for x in k.split())} and len(got) > 100


def test_lists_of_all_users_need_no_nested_loop(spark):
    r = random.Random(4)
    offers = [(f"o{k}", f"m{k % 4}", k % 9, " ".join(r.choice(WORDS) for _ in range(3)), r.choice([None, "Marca " + r.choice(WORDS)]), float(r.randint(1, 30))) for k in range(120)]
    items = [(f"l{k % 7}", f"i{k}", r.choice(["Leite", "int gral", "AGUA", "pao form", "x", "", "zzz", "e", None]), 2.0, r.choice([None, None, 3]), r.choice([None, None, "o5"])) for k in range(60)]
    o = spark.createDataFrame(offers, "offer_id string, market string, product long, name string, normalized_name string, ranking_price double")
    i = spark.createDataFrame(items, "list_id string, item string, query string, quantity double, product long, offer string")
    fold = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower().translate(str.maketrans("ãçáõ", "acao")))
    hit = lambda it, of: (it[4] is not None and it[4] == of[2]) or it[5] == of[0] or bool(toks := [t for t in fold(it[2]).split() if len(t) > 1]) and any(all(t in fold(n) for t in toks) for n in of[3:5])
    want = {(it[1], of[0]) for it in items for of in offers if hit(it, of)}
    rows = [(x.item, x.offer_id) for x in text_matches(i, o, "query", ["name", "normalized_name"]).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 200
    best = best_offers(i, o, ("name", "normalized_name"), ("list_id", "item"))
    by = {(it[1], of[1]): min((o2[5], o2[0]) for o2 in offers if o2[1] == of[1] and (it[1], o2[0]) in want) for it in items for of in offers if (it[1], of[0]) in want}
    assert {(x.item, x.market): (x.line_total / 2, x.offer_id) for x in best.collect()} == by
    for df in (best, text_matches(i, o, "query", ["name"])):
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_totals_of_lists_are_aggregated_in_place(spark):
    """No text is carried to the totals, so nothing is sorted for them; queries without a token reach no join."""
    o = spark.createDataFrame([("o1", "a", "leite integral", 3.0), ("o2", "a", "leite", 2.0), ("o3", "b", "leite", 4.0), ("o4", "b", "arroz", None)], "offer_id string, market string, name string, ranking_price double")
    i = spark.createDataFrame([("l", 1, "leite", 2.0, None), ("l", 2, "x", 1.0, "o1"), ("l", 3, "", 1.0, None), ("m", 1, "arroz leite", 1.0, "o3")], "list_id string, item int, query string, quantity double, offer string")
    df = list_baskets(i, o)
    got = {(r.list_id, r.market): (r.total, r.missing, r.complete) for r in df.collect()}
    assert got == {("l", "a"): (7.0, 1, False), ("l", "b"): (8.0, 2, False), ("m", "b"): (4.0, 0, True)}
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert not any("SortAggregate" in x and "list_id" in x for x in plan.split("\n"))
