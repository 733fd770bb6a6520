import json
from datetime import datetime

from pyspark.sql import functions as F

from pricewell.functions import text
from pricewell.operators import basket, documents, joins, resolve, series


def test_documents_in_nested_answers(spark):
    rows = [
        (1, json.dumps({"data": {"flyers": [{"name": "A", "pdfUrl": "http://x/a.pdf", "validity": {"initial": "01/02", "final": "08/02"}}, {"title": "B", "images_urls": ["http://x/1.jpg", "http://x/2.jpg"]}]}})),
        (2, json.dumps({"encartes": [{"url": "http://x/p.jpg"}, "http://x/c.pdf?v=1"], "logo": "http://x/logo.png"})),
        (3, "no json"),
        (4, None),
        (5, json.dumps([[[{"id": 7, "pages": [{"url": "http://x/only.webp"}]}]]])),
    ]
    got = documents.documents_in(spark.createDataFrame(rows, "id int, body string")).collect()
    assert {(r.id, r.url, r.title, r.pdf) for r in got} == {(1, "http://x/a.pdf", "A", True), (1, "http://x/1.jpg", "B", False), (2, "http://x/c.pdf?v=1", None, True), (5, "http://x/only.webp", None, False)}
    assert next(r for r in got if r.title == "A").valid_until == "08/02"
    deep = {"a": None}
    for _ in range(20):
        deep = {"a": deep, "z": "http://x/d.pdf"}
    assert 0 < len(documents.walk(deep)) <= 11 and len(documents.walk(["http://x/d.pdf"] * 200)) == 81
    assert documents.walk(deep)[-1]["cut"] and documents.walk(["http://x/d.pdf"] * 200)[-1]["cut"] and not any("cut" in d for d in documents.walk(["http://x/d.pdf"] * 81))


def test_candidates_merge(spark):
    a = spark.createDataFrame([("u", None, ["1"]), ("v", "t", None)], "url string, title string, page_urls array<string>")
    b = spark.createDataFrame([("u", "late", ["2", "1"]), ("v", "x", ["3"])], "url string, title string, page_urls array<string>")
    assert {(r.url, r.title, tuple(r.page_urls)) for r in documents.merge_candidates([a, b], "url").collect()} == {("u", "late", ("1", "2")), ("v", "t", ("3",))}


def test_labels(spark):
    lit = F.lit
    r = spark.range(1).select(text.worker_slug(lit("Pão de Açúcar!")).alias("a"), text.worker_slug(lit("wrk_x")).alias("b"), text.worker_slug(lit("!")).alias("c"), text.compact(lit(1234)).alias("d"), text.compact(lit(2000)).alias("e"), text.compact(lit(12)).alias("f"), text.distance_label(lit(0.5)).alias("g"), text.distance_label(lit(12.34)).alias("h"), text.expiry_label(lit(1)).alias("i"), text.instalment_label(lit(10), lit(199.9), lit(True)).alias("j")).first()
    assert tuple(r) == ("wrk_pao_de_acucar", "wrk_x", "wrk_flow", "1.2k", "2k", "12", "500 m", "12,3 km", "vence amanhã", "10x de R$ 199,90 sem juros")


def test_runs_and_flyers(spark):
    d = lambda h: datetime(2024, 1, 1, h)
    runs = spark.createDataFrame([(1, "m", d(1), d(2)), (2, "m", d(5), d(6)), (3, "n", d(1), d(2))], "run_id int, market string, begin timestamp, end timestamp")
    flyers = spark.createDataFrame([("f", "m", d(2), d(3)), ("g", "m", d(9), d(9))], "flyer_id string, market string, created_at timestamp, updated_at timestamp")
    offers = spark.createDataFrame([("g", "m", d(6)), ("g", "m", d(1)), ("z", "n", d(4))], "flyer_id string, market string, created_at timestamp")
    assert {tuple(r) for r in joins.touched_or_filled(runs, flyers, offers).collect()} == {(1, "f"), (2, "g")}


def test_two_store_split(spark):
    rows = [("a", "x", "o1", 1.0), ("a", "y", "o2", 2.0), ("b", "x", "o3", 1.0), ("c", "y", "o4", 1.0), ("c", "z", "o5", 0.5), ("d", "y", "o6", 1.0), ("e", "z", "o7", 9.0)]
    best = spark.createDataFrame(rows, "item string, market string, offer_id string, line_total double")
    got = {(r.item, r.market) for r in basket.split_two(best, 5).collect()}
    assert got == {("a", "x"), ("b", "x"), ("c", "z"), ("e", "z")}
    assert basket.split_two(best, 6).collect() == [], "an item that is nowhere ends the split"
    markets = spark.createDataFrame([("x",), ("y",), ("z",), ("empty",)], "market string")
    per = basket.baskets(best, 5, markets)
    assert {(r.market, r.total, r.missing) for r in per.collect()} == {("x", 2.0, 3), ("y", 4.0, 2), ("z", 9.5, 3), ("empty", 0.0, 5)}
    top = basket.best_single(per).first()
    assert top.market == "y" and top.savings_vs_worst == 0.0
    whole = basket.baskets(best.filter("item IN ('a', 'c')"), 2, markets)
    assert [(r.market, r.total) for r in basket.ranked(whole).collect()] == [("y", 3.0)]
    total = basket.split_summary(basket.split_two(best.filter("item IN ('a', 'c')"), 2), basket.best_single(whole)).first()
    assert (total.stores, total.split_total, total.savings_vs_best_single) == (2, 1.5, 1.5)
    items = spark.createDataFrame([("a", 1.0), ("q", 1.0)], "item string, quantity double")
    grid = basket.lines(best, items, best).collect()
    assert len(grid) == 6 and sum(r.missing for r in grid) == 4


def test_fixes_and_extents(spark):
    o = spark.createDataFrame([("o", "p", None, None, None, None, None)], "id string, canonical_product_id string, brand_id string, quantity string, unit string, quantity_value double, unit_normalized string")
    p = spark.createDataFrame([("p", "own", None, None)], "id string, brand_id string, quantity string, unit string")
    fixed, prod = resolve.apply_fix(o, p, spark.createDataFrame([("o", "b", "1,5", "Litro")], "id string, brand_id string, quantity string, unit string"))
    assert (fixed.first().quantity_value, fixed.first().unit_normalized, prod.first().brand_id, prod.first().unit) == (1.5, "l", "own", "l")
    s = spark.createDataFrame([(1.0, 2.0), (5.0, None)], "a double, b double")
    assert series.tallest(s, ["a", "b"]).first().tallest == 5.0 and series.extent(s, "a").first().domain_high == 5.2


def test_harvest_of_recorded_responses(spark, tmp_path):
    import base64

    row = lambda seq, url, told, body, status=200: json.dumps({"url": url, "status": status, "content_type": told, "body": base64.b64encode(body.encode()).decode(), "seq": seq})
    answer = json.dumps({"flyers": [{"title": "T", "images": ["http://x/1.jpg", "http://x/2.jpg"]}]})
    rows = [
        row(1, "http://x/a.pdf?v", "application/octet-stream", "?"), row(2, "http://x/a.pdf?v", "application/pdf", "?"), row(3, "http://x/b", "text/html", "%PDF-1.4"), row(4, "http://x/c.jpg", "image/jpeg", "?"),
        row(5, "http://x/list", "application/json", answer), row(6, "http://x/again", "application/json", answer), row(7, "http://x/graphql", "application/json", answer.replace("T", "U")), row(8, "http://x/gone.pdf", "application/pdf", "?", 404),
        row(9, "http://x/bad", "application/json", "{"), row(10, "http://x/none", None, "?"),
    ]
    for k in range(2):
        (tmp_path / f"{k}.jsonl").write_text("\n".join(rows[k::2]))
    got = documents.harvest(documents.recorded_responses(spark, str(tmp_path))).collect()
    assert {(r.url, r.title, r.pdf, r.source_url) for r in got} == {("http://x/a.pdf?v", None, True, None), ("http://x/b", None, True, None), ("http://x/1.jpg", "T", False, "http://x/list")} and len(got) == 3


def test_layout_by_market(spark, tmp_path):
    from pricewell.sources import sinks

    path = str(tmp_path / "offers")
    o = spark.createDataFrame([(k, f"m{k % 4}", "old") for k in range(40)], "id int, market string, state string")
    sinks.lay_out(o, path, ["market"])
    files = lambda m: sorted(p.name for p in (tmp_path / "offers" / f"market={m}").glob("*.parquet"))
    before = {m: files(m) for m in ("m0", "m1", "m2", "m3")}
    sinks.replace_parts(spark.createDataFrame([(100, "m1", "new")], o.schema), path, ["market"])
    assert {m for m, f in before.items() if files(m) != f} == {"m1"}
    read = spark.read.schema(o.schema).parquet(path)
    assert {(r.id, r.state) for r in read.filter("market = 'm1'").collect()} == {(100, "new")} and read.count() == 31
    scan = next(x for x in read.filter("market = 'm1'")._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x)
    assert "PartitionFilters: [isnotnull(market" in scan and "PushedFilters: []" in scan


def test_order_of_a_language(spark):
    from pricewell.functions.text import collated

    want = ["_x", "10 x", "9 x", "a b", "a-b", "ab", "agua", "Agua", "água", "Água", "cao", "Ção", "eclair", "éclair", "zebra", "Zebra"]
    df = spark.createDataFrame([(x,) for x in sorted(want)], "x string")
    assert [r.x for r in df.orderBy(collated(F.col("x"))).collect()] == want
