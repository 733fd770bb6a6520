from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pricewell.operators import filters, lifecycle, listing

NOW = datetime(2024, 6, 10)
AT = lambda: F.lit("2024-06-10").cast("timestamp")
day = lambda d, m=6: datetime(2024, m, d)
FLYER = "id string, supermarket_id string, source_id string, store_ids array<string>, title string, original_url string, external_id string, file_hash string, valid_from timestamp, valid_until timestamp, expired_at timestamp, status string, page_urls array<string>, storage_id string, created_at timestamp, updated_at timestamp"


def flyer(i, status="processed", begin=None, end=None, url=None, ext=None, stored="s", market="m"):
    return (i, market, "src", None, f"t{i}", url or f"u{i}", ext, "h", begin, end, None, status, None, stored, day(1), day(1))


def test_expiry_and_purge(spark):
    f = spark.createDataFrame([flyer("a", end=day(9)), flyer("b", end=NOW), flyer("c", "processing", end=day(1)), flyer("d", "expired", end=day(10, 5)), flyer("e", "expired", end=day(12, 5)), flyer("g")], FLYER)
    assert {r.id: r.status for r in lifecycle.expire(f, AT()).collect()} == {"a": "expired", "b": "processed", "c": "processing", "d": "expired", "e": "expired", "g": "processed"}
    pages = spark.createDataFrame([("p1", "d", 1), ("p2", "e", 1)], "id string, flyer_id string, page_number int")
    offers = spark.createDataFrame([("o1", "d"), ("o2", "e")], "id string, flyer_id string")
    left, p, o = lifecycle.purge(f, pages, offers, AT())
    assert {r.id for r in left.collect()} == {"a", "b", "c", "e", "g"} and {r.id for r in p.collect()} == {"p2"}
    assert {(r.id, r.source_title) for r in o.collect()} == {("o1", "td"), ("o2", None)}


def test_validity(spark):
    f = spark.createDataFrame([flyer("a", "expired", day(1), day(5)), flyer("b", begin=day(1))], FLYER)
    o = spark.createDataFrame([("o", "a", day(1), day(5))], "id string, flyer_id string, valid_from timestamp, valid_until timestamp")
    c = spark.createDataFrame([("a", None, day(20))], "id string, valid_from timestamp, valid_until timestamp")
    f2, o2 = lifecycle.set_validity(f, o, c, AT())
    assert {(r.id, r.status, r.valid_from, r.valid_until) for r in f2.collect()} == {("a", "processed", None, day(20)), ("b", "processed", day(1), None)}
    assert o2.first().valid_until == day(20)
    with pytest.raises(Exception, match="valid_from lies after"):
        lifecycle.set_validity(f, o, spark.createDataFrame([("a", day(9), day(2))], c.schema), AT())[0].collect()


def test_discovery(spark):
    f = spark.createDataFrame([flyer("a", url="x", stored=None), flyer("b", ext="e1"), flyer("c", "expired", url="z", stored=None)], FLYER)
    found = spark.createDataFrame([("m", "src", "new a", "x", None, ["p"], None, None, None), ("m", "src", None, "y", "e1", None, None, day(30), None), ("m", "src", None, "z", None, ["p"], None, None, None), ("m", "src", "n", "new", None, None, None, None, None), ("m2", "src", "n", "x", None, None, None, None, None)], "supermarket_id string, source_id string, title string, original_url string, external_id string, page_urls array<string>, valid_from timestamp, valid_until timestamp, store_ids array<string>")
    found = found.withColumn("found_at", F.lit(1)).unionByName(found.filter("title = 'new a'").withColumns({"found_at": F.lit(0), "title": F.lit("older")}))
    got = {(r.supermarket_id, r.original_url): r for r in lifecycle.discover(f, found, AT()).collect()}
    assert set(got) == {("m", "x"), ("m", "y"), ("m", "z"), ("m", "new"), ("m2", "x")}
    assert (got["m", "x"].id, got["m", "x"].status, got["m", "x"].title) == ("a", "discovered", "new a")
    assert (got["m", "y"].id, got["m", "y"].valid_until, got["m", "y"].status) == ("b", day(30), "processed")
    assert got["m", "z"].status == "expired" and got["m", "new"].status == "discovered"


def test_schedules(spark):
    flows = spark.createDataFrame([("f1", "m", "active", day(11), day(9), 0), ("f2", "m2", "active", None, None, 3), ("f3", "m", "disabled", None, None, 0)], "id string, supermarket_id string, status string, next_run_at timestamp, last_run_at timestamp, discovery_attempts int")
    markets = spark.createDataFrame([("m",), ("m",)], "supermarket_id string")
    assert {r.id: r.next_run_at for r in lifecycle.arm(flows, markets, AT()).collect()} == {"f1": NOW, "f2": None, "f3": None}
    assert {r.id: r.next_run_at for r in lifecycle.arm_periodic(flows, AT()).collect()} == {"f1": datetime(2024, 6, 9, 6), "f2": NOW, "f3": None}
    results = spark.createDataFrame([("f1", NOW, True, 0, None), ("f2", NOW, False, 0, None)], "id string, at timestamp, ok boolean, new_flyers int, error string")
    after, errors = lifecycle.record_runs(flows, results)
    done = {r.id: r for r in after.collect()}
    assert [(r.id, r.supermarket_id, r.message) for r in errors.collect()] == [("f2", "m2", "Discovery failed after 4 attempts")]
    assert (done["f1"].next_run_at, done["f1"].discovery_attempts) == (datetime(2024, 6, 10, 6), 0)
    assert (done["f2"].status, done["f2"].next_run_at, done["f2"].discovery_attempts) == ("error", datetime(2024, 6, 10, 8), 4)
    assert done["f3"].last_run_at is None
    f = spark.createDataFrame([flyer("a", end=day(9)), flyer("b", begin=day(12), market="m9"), flyer("d", "duplicate")], FLYER)
    pages = spark.createDataFrame([("p", "d"), ("q", "b")], "id string, flyer_id string")
    offers = spark.createDataFrame([("o", "d"), ("r", "b")], "id string, flyer_id string")
    swept, p, o, armed = lifecycle.sweep(f, pages, offers, flows, AT())
    assert {r.id: r.status for r in swept.collect()} == {"a": "expired", "b": "processed"} and {r.id: r.next_run_at for r in armed.collect()}["f1"] <= NOW
    assert [r.id for r in p.collect()] == ["q"] and [r.id for r in o.collect()] == ["r"]
    later = spark.createDataFrame([flyer("a", end=day(9)), flyer("b", begin=day(30)), flyer("c", "failed", end=day(10), market="m2"), flyer("e", end=day(10), market="m3")], FLYER)
    assert {r.supermarket_id for r in lifecycle.to_discover(later, AT()).collect()} == {"m3"}


def test_lists(spark):
    f = spark.createDataFrame([flyer("a", begin=day(1), end=day(3)), flyer("b", "duplicate"), flyer("c", market="m2", begin=day(8), end=day(9))], FLYER)
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(listing.flyer_list(f)) == {"a", "b", "c"} and ids(listing.flyer_list(f, supermarket_id="m", without_duplicates=True)) == {"a"}
    assert ids(listing.flyer_list(f, missing_validity=True)) == {"b"} and ids(listing.flyer_list(f, begin=day(4))) == {"c"}
    assert ids(listing.contains_text(f, " TÁ ", "title")) == {"a"} and ids(listing.contains_text(f, " ", "title")) == {"a", "b", "c"}
    o = spark.createDataFrame([("1", "f", "m", "pending", None), ("2", "f", "m", "pending", "APP_ONLY")], "id string, flyer_id string, supermarket_id string, validation_status string, eligibility string")
    assert ids(listing.offer_list(o, flyer_id="f", eligibility="ALL_CUSTOMERS")) == {"1"}
    w = spark.createDataFrame([("1", "Rede Um", "m", ["api"], "fail", None, 0.5, 0), ("2", "Rede Dois", "m", ["pdf"], "running", None, None, 3), ("3", "Outra", "n", ["html"], "queue", NOW, 0.85, 1)], "id string, supermarket_name string, supermarket_id string, source_kinds array<string>, status string, last_run_at timestamp, parse_rate double, jobs_24h int")
    assert ids(listing.worker_list(w, AT(), networks=["Rede"], sources=["pdf", "html"])) == {"2"}
    assert ids(listing.worker_list(w, AT(), health=["fail", "stale"])) == {"1"} and ids(listing.worker_list(w, AT(), parse_below=0.9, jobs="some")) == {"3"}
    u = spark.createDataFrame([("http://A", "x"), ("http://b", "Deny"), ("http://c", None)], "url string, title string")
    assert {r.url for r in listing.without_denied(u, spark.createDataFrame([("HTTP://a",), ("deny",)], "key string")).collect()} == {"http://c"}


def test_states(spark):
    states = [("error", None, 0, "fail"), ("active", "cancelled", 5, "queue"), ("active", "duplicate", 5, "review"), ("active", "failed", 5, "fail"), ("draft", "running", 0, "running"), ("testing", None, 9, "review"), ("active", None, 1, "running"), ("active", "success", 0, "queue"), ("disabled", None, 3, "queue")]
    df = spark.createDataFrame(states, "f string, l string, j int, want string")
    assert [r.want for r in df.filter(filters.ops_status(F.col("f"), F.col("l"), F.col("j")) != F.col("want")).collect()] == []
    none = F.array().cast("array<struct<name:string,description:string,requirement:string>>")
    r = spark.range(1).select(listing.public_condition(F.lit(None).cast("string"), none).alias("a"), listing.public_condition(F.lit("APP_ONLY"), none, {"APP_ONLY": "Só no app"}).alias("b"), listing.public_condition(F.lit("APP_ONLY"), F.array(F.struct(F.lit(" n ").alias("name"), F.lit("n").alias("description"), F.lit(None).cast("string").alias("requirement")))).alias("c"), filters.source_kinds(F.array(F.lit("dynamic"), F.lit("click")), F.lit("")).alias("d"), filters.source_kinds(F.array().cast("array<string>"), F.lit("http://x/a.pdf?b")).alias("e")).first()
    assert (r.a.kind, r.b.text, r.c.text, r.d, r.e) == ("none", "Só no app", "n", ["api", "html"], ["pdf"])


def test_discovery_is_a_replay_of_whole_markets(spark, monkeypatch):
    """Chains through URLs and external ids, finds without either, flyers known by external id alone; labels spread over rows with both keys only."""
    import random

    rng = random.Random(5)
    pick = lambda kind, n, none=0.3: None if rng.random() < none else f"{kind}{rng.randrange(n)}"
    old = [flyer(f"f{k:03d}", rng.choice(["processed", "expired"]), url=f"u{rng.randrange(60)}", ext=pick("e", 40), stored=rng.choice(["s", None]), market=rng.choice("mn")) for k in range(70)]
    new = [(rng.choice("mn"), "src", pick("t", 99), pick("u", 60, 0.05), pick("e", 40), rng.choice([["p"], None]), None, None, None, k) for k in range(90)]
    f = spark.createDataFrame(old, FLYER)
    found = spark.createDataFrame(new, "supermarket_id string, source_id string, title string, original_url string, external_id string, page_urls array<string>, valid_from timestamp, valid_until timestamp, store_ids array<string>, found_at int")
    seen, plain = [], lifecycle.components
    monkeypatch.setattr(lifecycle, "components", lambda edges: seen.append(edges.select("node", "key").distinct().count()) or plain(edges))
    got = sorted((r.supermarket_id, r.original_url or "", r.external_id or "", r.title or "", r.status, r.id if r.id[0] == "f" and len(r.id) == 4 else "new") for r in lifecycle.discover(f, found, AT()).collect())
    here = [r.asDict() for r in sorted(f.collect(), key=lambda r: (r.created_at, r.id))]
    for n in sorted(found.collect(), key=lambda r: r.found_at):
        same = lambda c: next((r for r in here if n[c] and r["supermarket_id"] == n["supermarket_id"] and r[c] == n[c]), None)  # noqa: E731, B023
        hit = same("original_url") or same("external_id")
        if hit is None:
            here.append({**n.asDict(), "id": "new", "status": "discovered", "storage_id": None})
            continue
        if n.page_urls and not hit["storage_id"] and hit["status"] != "expired":
            hit["status"] = "discovered"
        hit.update({c: n[c] for c in ("title", "original_url", "external_id") if n[c]})
    assert got == sorted((r["supermarket_id"], r["original_url"] or "", r["external_id"] or "", r["title"] or "", r["status"], r["id"]) for r in here)
    both = {(r[0], r[3], r[4]) for r in new if r[4]} | {(r[1], r[5], r[6]) for r in old if r[6]}
    assert len(seen) == 1 and seen[0] <= len(both)
