from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewell.operators import filters, joins, keyed, offers, resolve, series
from pricewell.sources import sinks, tables
from pricewell.streaming import views

PAGE = """MACARRÃO DA SERRA
PARAFUSO
500G

DE 9,80 cada
POR 6,40

BISCOITO SOL
2 kg
R$ 14,30

OFERTA RELÂMPAGO
SUCO DE CAJU
1 L
DE R$ 8,00 POR R$ 6,00"""


def test_page_text_to_offers(spark):
    pages = spark.createDataFrame([(1, 1, PAGE, 0.8), (2, 1, "CAFÉ MOÍDO\n250G\nR$ 21,50\npreço clube", 0.8), (3, 1, None, None), (4, 1, "", 0.5), (5, 1, "FOGÃO\n6x de R$ 100,00\nou 6x 99,00\nMESA 540,00 à vista", None)], "page_id int, page_number int, text string, confidence double")
    got = {(r.page_id, r.name.split()[0]): r for r in offers.parse_pages(pages).collect()}
    assert {k for k in got if k[0] == 1} == {(1, "PARAFUSO"), (1, "BISCOITO"), (1, "SUCO")}
    two_lines, one_line = got[1, "PARAFUSO"], got[1, "SUCO"]
    assert (two_lines.price, two_lines.original_price, two_lines.discount_percentage, two_lines.quantity) == (6.4, 9.8, 34.7, "500g")
    assert (one_line.price, one_line.original_price, one_line.confidence) == (6.0, 8.0, 0.8)
    assert got[1, "BISCOITO"].price == 14.3 and abs(got[1, "BISCOITO"].confidence - 0.6) < 1e-9
    assert got[2, "CAFÉ"].eligibility == "LOYALTY_PROGRAM" and got[2, "CAFÉ"].eligibility_status == "ai_validated" and abs(got[2, "CAFÉ"].confidence - 0.68) < 1e-9
    assert (got[5, "FOGÃO"].price, got[5, "FOGÃO"].installment_count) == (540.0, 6)


def test_a_neighbours_quantity_is_not_taken_over(spark):
    pages = spark.createDataFrame([(1, 1, "LEITE 1 L 4,00\nPÃO FRANCÊS 2,00", 0.8)], "page_id int, page_number int, text string, confidence double")
    got = {r.price: r.quantity for r in offers.parse_pages(pages).collect()}
    assert got[4.0] == "1l"


def test_json_to_offers(spark):
    raw = [
        '```json\n{"offers":[{"name":"Queijo da Roça","price":31.5,"originalPrice":42}]}\n```',
        '{"offers":[{"name":"Manteiga, }","price":7.25,}],}',
        '{"offers":[{"name":"Iogurte","price":3.1},{"name":"Mel","price":9.9',
        "not json",
        '{"confidence":0.9,"offers":[{"name":"Vinho Tinto 750ml","brand":"SERRANO","quantity":"750","unit":"ML","price":"R$ 45,60","originalPrice":"57,00"},{"name":"Vinho Tinto 750 ML","brand":"serrano","quantity":"750","unit":"ml","price":1},{"name":"x","price":1},{"name":"98765","price":2.5},{"name":"Joia","price":300000},{"name":"Sabão","brand":"n/a","price":6.5}]}',
        '{"offers":[{"name":"Bicicleta,}","price":"150,00","installmentCount":"8","installmentAmount":"150,00","confidence":0.95}]}',
        '{"offers":[{"name":"Azeite","price":20,"eligibility":"CPF_REQUIRED"},{"name":"Sal","price":2,"eligibility":"CPF_REQUIRED","evidence":{"text":"cpf"},"confidence":0.8}]}',
    ]
    df = spark.createDataFrame([(k, 2, r) for k, r in enumerate(raw)], "page_id int, page_number int, raw string")
    got = {(r.page_id, r.name): r for r in offers.offers_from_json(df).collect()}
    assert set(got) == {(0, "Queijo da Roça"), (1, "Manteiga"), (2, "Iogurte"), (2, "Mel"), (4, "Vinho Tinto 750ml"), (4, "Sabão"), (5, "Bicicleta,"), (6, "Azeite"), (6, "Sal")}
    r = got[4, "Vinho Tinto 750ml"]
    assert (r.brand, r.unit, r.price, r.discount_percentage, r.page_number, r.confidence) == ("Serrano", "ml", 45.6, 20.0, 2, 0.7)
    assert got[4, "Sabão"].brand is None
    assert (got[5, "Bicicleta,"].price, got[5, "Bicicleta,"].installment_count) == (1200.0, 8)
    assert (got[6, "Azeite"].eligibility, got[6, "Sal"].eligibility, got[6, "Sal"].eligibility_confidence) == ("UNKNOWN", "CPF_REQUIRED", 0.8)


def test_validation_order(spark):
    rows = [("abcd", 10.0, 0.9, "validated"), ("abc", 10.0, 0.9, "rejected"), ("abcd", 0.0, 0.9, "rejected"), ("abcd", 10.0, 0.499, "rejected"), ("abcd", 5001.0, 0.9, "suspicious"), ("abcd", 5000.0, None, "validated"), ("abcd", 0.05, None, "suspicious")]
    df = spark.createDataFrame(rows, "n string, p double, c double, want string")
    assert df.filter(filters.validation_status(F.col("n"), F.col("p"), F.col("c")) != F.col("want")).count() == 0


def test_ranges_meet_at_bounds_and_across_buckets(spark):
    t = lambda h, m=0: datetime(2024, 1, 1, h, m)
    runs = spark.createDataFrame([(1, "a", t(1), t(3)), (2, "b", t(1), t(2))], "id int, k string, b timestamp, e timestamp")
    rows = spark.createDataFrame([("a", t(1)), ("a", t(2, 30)), ("a", t(3)), ("a", t(3, 1)), ("b", t(5)), ("c", t(1))], "k string, ts timestamp")
    got = joins.in_range(runs, rows, "k", "b", "e", "ts", 3600).groupBy("id").count().collect()
    assert [(r.id, r["count"]) for r in got] == [(1, 3)]


def test_fallback_and_scope(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    none, some = spark.createDataFrame([(9,)], "k int"), spark.createDataFrame([(2,), (2,)], "k int")
    assert joins.semi_or_all(df, none, "k").count() == 2
    assert [r.v for r in joins.semi_or_all(df, some, "k").collect()] == ["y"]
    s = spark.createDataFrame([(1, None), (2, []), (3, ["a"]), (4, ["b"])], "i int, s array<string>")
    assert {r.i for r in s.filter(joins.applies_to(F.col("s"), F.array(F.lit("b")))).collect()} == {1, 2, 4}


def test_keyed(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("b", 1, None)], "k string, t int, v double")
    assert [(r.k, r.t, r.v) for r in keyed.forward_fill(df, ["k"], "t", "v").orderBy("k", "t").collect()] == [("a", 1, None), ("a", 2, 5.0), ("a", 3, 5.0), ("b", 1, None)]
    q = keyed.neighbours(spark.createDataFrame([(1,), (2,), (3,)], "id int"), [F.col("id")], "id").orderBy("id").collect()
    assert [(r.prev, r.next) for r in q] == [(3, 2), (1, 3), (2, 1)]
    assert keyed.neighbours(spark.createDataFrame([(1,)], "id int"), [F.col("id")], "id").first().next is None
    near = keyed.nearest_point(spark.createDataFrame([(1.0,), (3.0,), (10.0,)], "x double"), "x", spark.createDataFrame([(2.0,), (0.0,), (9.0,), (50.0,)], "q double"), "q").collect()
    assert {r.q: r.nearest for r in near} == {2.0: 1.0, 0.0: 1.0, 9.0: 10.0, 50.0: 10.0}
    assert keyed.first_by(df, ["k"], [F.desc("t")]).count() == 2


def test_series(spark):
    line = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 7.0)], "s string, x int, y double")
    assert {(r.s, r.x, r.projected) for r in series.project(line, "s", "x", "y", 2).collect()} == {("a", 3, 6.0), ("a", 4, 8.0), ("b", 2, 7.0), ("b", 3, 7.0)}


def slow_picks(y, most):
    """Largest triangles over places, bucket after bucket, as plain loops."""
    n = len(y)
    if most >= n or most < 3:
        return list(range(n))
    size, out = (n - 2) / (most - 2), [0]
    for i in range(most - 2):
        lo, hi = int((i + 1) * size) + 1, min(int((i + 2) * size) + 1, n - 1)
        nlo, nhi = int((i + 2) * size) + 1, min(int((i + 3) * size) + 1, n)
        mx, my = (sum(range(nlo, nhi)) / (nhi - nlo), sum(y[nlo:nhi]) / (nhi - nlo)) if nhi > nlo else (n - 1, y[-1])
        a = out[-1]
        best, at = -1.0, lo
        for j in range(lo, hi):
            area = abs((a - mx) * (y[j] - y[a]) - (a - j) * (my - y[a])) * 0.5
            if area > best:
                best, at = area, j
        out.append(at)
    return [*out, n - 1]


@pytest.mark.parametrize("batch", [50, 10_000])
def test_picks_are_those_of_plain_loops(spark, batch):
    rng = np.random.default_rng(4)
    lines = {s: rng.normal(size=n).cumsum() for s, n in (("a", 2000), ("b", 333), ("c", 17), ("d", 16), ("e", 1))} | {"peak": np.where(np.arange(500) == 250, 9.0, np.sin(np.arange(500) / 20))}
    df = spark.createDataFrame([(s, k, float(v)) for s, y in lines.items() for k, v in enumerate(y)], "s string, x long, y double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = series.decimate(df, "s", ["x"], "y", 16).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for s, y in lines.items():
        assert [r.place for r in sorted((r for r in got if r.s == s), key=lambda r: r.pick)] == slow_picks(y.tolist(), 16), s
    assert 250 in {r.place for r in got if r.s == "peak"}


def test_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    rows = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert rows(sinks.upsert(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(sinks.insert_absent(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(sinks.delete(old, new, ["k"])) == [(1, "a")]
    assert sinks.patch(old, spark.createDataFrame([(2, None)], "k int, v string"), ["k"], ["v"]).filter("k = 2").first().v is None
    assert rows(sinks.toggle(old, spark.createDataFrame([(2, "b"), (9, "z")], "k int, v string"))) == [(1, "a"), (9, "z")]
    assert rows(sinks.replace_scope(old, new, F.col("k") == 2, F.lit(True))) == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(sinks.replace_scope(old, new, None, F.col("k") == 1)) == [(1, "a"), (2, "b")]
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, path)
    sinks.swap(spark, old, path)
    sinks.swap(spark, sinks.upsert(spark.read.parquet(sinks.current(spark, path)), new, ["k"]), path)
    assert rows(spark.read.parquet(sinks.current(spark, path))) == [(1, "a"), (2, "B"), (3, "c")]
    (tmp_path / "t" / "v=7").mkdir()  # a write that died leaves a version without its mark
    assert rows(spark.read.parquet(sinks.current(spark, path))) == [(1, "a"), (2, "B"), (3, "c")]
    sinks.wipe(spark, {"t": (path, "k int, v string")})
    assert rows(spark.read.parquet(sinks.current(spark, path))) == []
    assert set(sinks.cascade(new, "k", {"c": (old, "k")})) == {"c"}


def test_resolution(spark):
    o = spark.createDataFrame([("o1", "Arroz  Camil", "CAMIL", "5", "kg", 10.0, 12.0, None), ("o2", "arroz camil", "Camil", "5", "KG", 9.0, None, "APP_ONLY"), ("o3", "Leite", "", None, None, 4.0, None, None)], "id string, name string, brand string, quantity string, unit string, price double, original_price double, eligibility string")
    o = o.withColumns({"conditions": F.array().cast("array<struct<name:string>>"), "created_at": F.lit("2024-01-01").cast("timestamp"), "supermarket_id": F.lit("m"), "valid_from": F.lit(None).cast("timestamp"), "valid_until": F.lit(None).cast("timestamp")})
    n = resolve.normalize_offers(o)
    by = {r.id: r for r in n.collect()}
    assert by["o2"].member_price == 9.0 and by["o2"].membership_name == "APP_ONLY" and by["o1"].public_price == 10.0
    brands = spark.createDataFrame([("b1", "Camil Alimentos", "camil-alimentos", ["Camil"])], "id string, name string, slug string, aliases array<string>")
    with_brand, new_brands = resolve.ensure_brands(n, brands)
    assert {r.id: r.brand_id for r in with_brand.collect()} == {"o1": "b1", "o2": "b1", "o3": None} and new_brands.count() == 0
    products = spark.createDataFrame([], tables.SCHEMAS["canonical_products"])
    linked, new = resolve.resolve_products(with_brand, products)
    ids = {r.id: r.canonical_product_id for r in linked.collect()}
    assert ids["o1"] == ids["o2"] != ids["o3"] and {r.canonical_name for r in new.collect()} == {"Arroz  Camil", "Leite"}
    history = spark.createDataFrame([("h", "o1")], "id string, offer_id string")
    assert {r.offer_id for r in resolve.new_price_rows(linked, history).collect()} == {"o2", "o3"}
    moved, _, left = resolve.merge_brand(with_brand, products, brands.unionByName(spark.createDataFrame([("b2", "X", "x", None)], brands.schema)), "b1", "b2")
    assert left.first().aliases == ["Camil Alimentos", "Camil"] and moved.filter("brand_id = 'b1'").count() == 0


def test_streams(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "in")
    e.filter("event_id % 2 = 0").coalesce(1).write.parquet(src)
    stream = views.event_stream(spark, src)
    q = views.daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    want = {(str(r.day)[:10], r.event_type): r.n for r in e.filter("event_id % 2 = 0").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert {(str(r.day)[:10], r.event_type): r.n for r in spark.sql("SELECT * FROM daily").collect()} == want
    out, check = str(tmp_path / "out"), str(tmp_path / "c2")
    for half in (None, 1):
        if half is not None:
            e.filter("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(src)
        q = views.keep_latest(views.event_stream(spark, src, 1), out, ["user_id"], ["ts", "event_id"], check).trigger(availableNow=True).start()
        q.awaitTermination()
    last = max(int(p.name[2:]) for p in (tmp_path / "out").glob("v=*"))
    got = {r.user_id: r.event_id for r in spark.read.parquet(f"{out}/v={last}").collect()}
    assert got == {r.user_id: r.event_id for r in e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")).collect()}


def test_nearest_of_many_beyond_the_ends(spark):
    """Most values lie beyond the last point and many are equal: each range is walked once, whatever lies in it."""
    x, q = [float(v) for v in (3, 3, 7, 7, 20, 21)] * 50, [float((k * 37) % 5000 - 100) for k in range(3000)] + [5.0] * 500
    df = keyed.nearest_point(spark.createDataFrame([(v,) for v in x], "x double"), "x", spark.createDataFrame([(v,) for v in q], "q double"), "q")
    got = sorted((r.q, r.nearest) for r in df.collect())
    assert got == sorted((t, min(set(x), key=lambda v: (abs(t - v), v))) for t in q)
    assert "currentrow$(), unboundedfollowing$()" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_counts_in_ranges_without_pairs(spark):
    """Ends are closed, ids may repeat, intervals may be empty, end before they begin or reach over many cells."""
    t = lambda n: datetime.fromtimestamp(1_700_000_000 + n)
    runs = [(k, k % 3, (k * 977) % 9000, (k * 977) % 9000 + (k % 7 - 1) * 1500) for k in range(120)] + [(5, 1, 0, 9000), (200, 0, 30, 30), (201, None, 0, 9000), (202, 9, 0, 9000)]
    points = [(k, k % 4 if k % 11 else None, k * 10) for k in range(900)] + [(1000, 0, 30)]
    r = spark.createDataFrame([(k, m, t(b), t(e)) for k, m, b, e in runs], "id int, m int, b timestamp, e timestamp")
    p = spark.createDataFrame([(k, m, t(at)) for k, m, at in points], "k int, m int, at timestamp")
    counts = {"n": F.lit(1), "even": F.col("k") % 2 == 0}
    got = {x.id: (x.n, x.even) for x in joins.range_counts(joins.range_marks(r, p, "id", "m", "b", "e", "at", counts), "id", "m", list(counts), 600).collect()}
    want = {}
    for k, m, b, e in runs:
        hit = [x for x, n, at in points if n is not None and n == m and b <= at <= e]
        a, c = want.get(k, (0, 0))
        want[k] = (a + len(hit), c + sum(x % 2 == 0 for x in hit))
    assert {k: got.get(k, (0, 0)) for k in want} == want and want[5][0] > 225


def test_run_flyers_are_single_without_a_table_of_pairs(spark):
    """A flyer made and changed in one window is told once, also where offers fill in and where a run stands in two rows."""
    import re

    t = lambda n: datetime.fromtimestamp(1_700_000_000 + n * 3600)
    runs = [(1, 1, 0, 100), (2, 1, 40, 60), (3, 2, 0, 50), (4, 1, 5, 30), (4, 1, 20, 70), (5, 2, 60, 90), (6, 3, 0, 9)]
    flyers = [(10, 1, 10, 20), (11, 1, 50, None), (12, 1, None, 45), (13, 1, 55, 55), (14, 2, 95, 96), (10, 1, 25, None)]
    offers = [(20, 2, 10), (20, 2, 12), (21, 2, 50), (21, 2, 70), (20, 2, 61), (20, 2, 88), (22, 3, 10)]
    at = lambda n: None if n is None else t(n)
    r = spark.createDataFrame([(k, m, t(b), t(e)) for k, m, b, e in runs], "run_id int, market int, begin timestamp, end timestamp")
    f = spark.createDataFrame([(k, m, at(c), at(u)) for k, m, c, u in flyers], "flyer_id int, market int, created_at timestamp, updated_at timestamp")
    o = spark.createDataFrame([(k, m, t(c)) for k, m, c in offers], "flyer_id int, market int, created_at timestamp")
    direct = {(k, x) for k, m, b, e in runs for x, n, *times in flyers if n == m and any(v is not None and b <= v <= e for v in times)}
    want = direct | {(k, x) for k, m, b, e in runs for x, n, c in offers if n == m and b <= c <= e and k not in {d for d, _ in direct}}
    df = joins.touched_or_filled(r, f, o)
    assert sorted(tuple(x) for x in df.collect()) == sorted(want)
    # the only grouping of pairs is that of run ids in several rows, once for flyers and once for offers
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Aggregate \[run_id#\d+, flyer_id#\d+\]", plan)) == 2
    assert len(re.findall(r"_rows#\d+L > 1\)", plan)) == 2


def test_equal_areas_are_picked_as_in_sql(spark):
    """Places 6 and 8 span the same area; the mean's last bit, and so the order of its additions, decides."""
    import duckdb

    import pricewell.plans  # noqa: F401  registers the queries
    from pricewell.registry import ORACLES

    values = [31.88] + [50.0] * 4 + [23.3, 16.7, 41.57, 86.33, 29.97] + [63.08, 132.52, 12.61, 114.98, 4.51] + [50.0] * 53
    con = duckdb.connect(config={"threads": 1})
    con.execute("CREATE TABLE events AS SELECT 1::BIGINT AS user_id, i::BIGINT AS ts, i::BIGINT AS event_id, v AS value FROM (SELECT unnest(range(len($1))) AS i, unnest($1::DOUBLE[]) AS v)", [values])
    want = set(con.execute(ORACLES["lttb"]).fetchall())
    assert (1, 1, 8) in want
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "user_id long, ts long, value double")
    for rows in ("10000", "7"):  # in one batch and in many
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            assert {tuple(r) for r in series.decimate(df, "user_id", ["ts"], "value", 16).collect()} == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pages_are_dealt_over_all_cores(spark):
    """Few small files make few tasks, and a page's parsing is most of the work."""
    pages = spark.createDataFrame([(1, 1, PAGE, 0.9), (2, 1, "", 0.9), (3, 1, None, None)], "page_id long, page_number int, text string, confidence double").coalesce(1)
    answers = spark.createDataFrame([(1, 1, '{"offers":[{"name":"Arroz","price":"3"},{"name":"12","price":"3"}]}')], "page_id long, page_number int, raw string").coalesce(1)
    for df in (offers.parse_pages(pages), offers.offers_from_json(answers)):
        assert f"RoundRobinPartitioning({4 * spark.sparkContext.defaultParallelism})" in df._jdf.queryExecution().executedPlan().toString()
        assert {r.page_id for r in df.collect()} == {1}
