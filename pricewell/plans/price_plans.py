"""Prices across markets: comparison, product list, boards and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.functions.dates import calendar
from pricewell.functions.money import discount_catalogue
from pricewell.functions.semantics import half_up, spread_pct, valid_at
from pricewell.operators.keyed import forward_fill, last_before, top_groups
from pricewell.plans.frames import half
from pricewell.registry import query
from pricewell.sources.tables import PRICES_SQL, prices, table

AS_OF = "2001-10-01 00:00:00"
START, DAYS = "2001-08-31", 30


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _active():
    return F.coalesce(valid_at(_as_of(), F.col("valid_from"), F.col("valid_until")), F.lit(False))


def latest_per_market(p: DataFrame, columns: list[str], prefer_active: bool = False) -> DataFrame:
    """The newest price of each product and market (the newest active one, where asked and there is one)."""
    order = ([_active()] if prefer_active else []) + [F.col("created_at"), F.col("offer_id")]
    w = p.groupBy("product", "market").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r"))
    return w.select("product", "market", *[F.col("_r")[c].alias(c) for c in columns])


def compare(p: DataFrame, markets: list | None = None, only_club: bool = False, only_active: bool = True, coverage: str = "any", limit: int | None = 100) -> DataFrame:
    """Per product: markets with their latest price, lowest and highest, spread and the cheapest market; widest spread first.

    ``coverage``: products of ``any`` number of markets, of a ``single`` one or of several (``multi``).
    """
    if markets:
        p = p.filter(F.col("market").isin(markets))
    if only_active:
        p = p.filter(_active())
    if only_club:
        p = p.filter("club")
    latest = latest_per_market(p, ["price", "club", "offer_id"])
    agg = latest.groupBy("product").agg(
        F.count(F.lit(1)).alias("market_count"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.min_by("market", F.struct("price", "market")).alias("cheapest_market"), F.array_sort(F.collect_list(F.struct("market", "price", "club"))).alias("by_market")
    )
    agg = {"single": agg.filter("market_count = 1"), "multi": agg.filter("market_count >= 2")}.get(coverage, agg)
    out = agg.withColumn("spread_pct", spread_pct(F.col("min_price"), F.col("max_price"), 0.0))
    return out if limit is None else out.orderBy(F.desc("spread_pct"), "product").limit(limit)


def _compared_sql(where: str, having: str, limit: int | None) -> str:
    return f"""WITH {PRICES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY product, market ORDER BY created_at DESC, offer_id DESC) AS rn FROM prices WHERE {where}),
a AS (SELECT product, count(*) AS market_count, min(price) AS min_price, max(price) AS max_price, arg_min(market, (price, market)) AS cheapest_market, string_agg(CAST(market AS STRING) || ':' || CAST(CAST(floor(price * 100 + 0.5) AS BIGINT) AS STRING), ',' ORDER BY market) AS by_market FROM r WHERE rn = 1 GROUP BY product {having})
SELECT a.*, CASE WHEN min_price > 0 THEN {half('(max_price - min_price) / min_price * 100', 1)} ELSE 0.0 END AS spread_pct, p_name AS name, p_brand AS brand FROM a LEFT JOIN part ON p_partkey = product{f" ORDER BY spread_pct DESC, product LIMIT {limit}" if limit else ""}"""


def _named(compared: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the product's name and brand, joined after the limit, and its markets in a line."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    line = F.array_join(F.transform("by_market", lambda x: F.concat_ws(":", x["market"].cast("string"), F.floor(x["price"] * 100 + 0.5).cast("long").cast("string"))), ",")
    return compared.withColumn("by_market", line).join(names, "product", "left")


_ACTIVE_SQL = f"valid_from <= TIMESTAMP '{AS_OF}' AND valid_until >= TIMESTAMP '{AS_OF}'"


@query("compare_markets", _compared_sql(_ACTIVE_SQL, "", 100))
def compare_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose live prices differ most across markets."""
    return _named(compare(prices(spark, sf_dir)), spark, sf_dir)


@query("compare_club_prices", _compared_sql("club AND market IN (1, 2, 3, 4, 5, 6, 7, 8, 9)", "HAVING count(*) >= 2", 50))
def compare_club_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members' prices of all times at nine markets, products that several of them had."""
    return _named(compare(prices(spark, sf_dir), list(range(1, 10)), only_club=True, only_active=False, coverage="multi", limit=50), spark, sf_dir)


@query("compare_all", _compared_sql("true", "HAVING count(*) >= 2", None))
def compare_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product with several markets, over all prices."""
    return _named(compare(prices(spark, sf_dir), only_active=False, coverage="multi", limit=None), spark, sf_dir)


@query(
    "product_board",
    f"""WITH {PRICES_SQL}, own AS (SELECT *, {_ACTIVE_SQL} AS active FROM prices WHERE product = 1), b AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY active DESC, created_at DESC, offer_id DESC) AS rn FROM own)
SELECT 'board' AS part, CAST(market AS STRING) AS k, price AS v FROM b WHERE rn = 1 UNION ALL SELECT 'history', offer_id, price FROM (SELECT * FROM own ORDER BY created_at DESC, offer_id DESC LIMIT 200) UNION ALL SELECT 'offers', offer_id, coalesce(original, price) FROM (SELECT * FROM own ORDER BY created_at DESC, offer_id DESC LIMIT 80) UNION ALL SELECT DISTINCT 'brands', p_brand, 0.0 FROM part
UNION ALL SELECT 'series', strftime(day, '%Y-%m-%d') || '|' || CAST(market AS STRING), price FROM (
  SELECT day, market, (SELECT arg_max(o.price, (o.created_at, o.offer_id)) FROM own o WHERE o.market = m.market AND o.created_at < g.day + INTERVAL 1 DAY) AS price
  FROM (SELECT CAST(unnest(generate_series(DATE '{START}', DATE '2001-09-29', INTERVAL 1 DAY)) AS DATE) AS day) g, (SELECT DISTINCT market FROM own WHERE created_at < TIMESTAMP '2001-09-30') m)""",
)
def product_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything about one product: its board, its newest 200 prices, 80 offers, the brands to choose from, and thirty days of each market's price carried forward."""
    own = prices(spark, sf_dir).filter("product = 1").withColumn("active", _active())
    newest = [F.desc("created_at"), F.desc("offer_id")]
    part = lambda df, name, k, v: df.select(F.lit(name).alias("part"), k.cast("string").alias("k"), v.cast("double").alias("v"))
    board = part(latest_per_market(own, ["price"], prefer_active=True), "board", F.col("market"), F.col("price"))
    history = part(own.orderBy(*newest).limit(200), "history", F.col("offer_id"), F.col("price"))
    offers = part(own.orderBy(*newest).limit(80), "offers", F.col("offer_id"), F.coalesce("original", "price"))
    brands = part(table(spark, sf_dir, "part").select("p_brand").distinct(), "brands", F.col("p_brand"), F.lit(0.0))
    before = own.filter(F.col("created_at") < F.lit("2001-09-30").cast("timestamp_ntz"))
    line = part(_series(before, before.select("market").distinct()), "series", F.concat_ws("|", "day", F.col("market").cast("string")), F.col("price"))
    return board.unionByName(history).unionByName(offers).unionByName(brands).unionByName(line)


def _series(p: DataFrame, markets: DataFrame) -> DataFrame:
    """(day, market, price) of thirty days: last price of the day, carried forward, begun with the last one before. Spark holds few markets, by their size."""
    own = p.join(markets, "market")
    begin = F.lit(f"{START} 00:00:00").cast("timestamp_ntz")
    inside = own.filter((F.col("created_at") >= begin) & (F.col("created_at") < F.lit("2001-09-30").cast("timestamp_ntz")))
    daily = inside.groupBy(F.to_date("created_at").alias("day"), "market").agg(F.max_by("price", F.struct("created_at", "offer_id")).alias("price"))
    seed = last_before(own, ["market"], "created_at", begin, "offer_id", "price", "price").select(F.date_sub(F.to_date(F.lit(START)), 1).alias("day"), "market", "price")
    grid = markets.crossJoin(F.broadcast(calendar(markets.sparkSession, START, DAYS))).join(daily, ["day", "market"], "left")  # thirty days
    filled = forward_fill(grid.unionByName(seed, allowMissingColumns=True), ["market"], "day", "price")
    return filled.filter(F.col("day") >= F.lit(START)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "market", "price")


@query(
    "list_products",
    f"""WITH {PRICES_SQL},
a AS (SELECT product, count(DISTINCT market) AS market_count, count(*) AS offer_count,
  count(DISTINCT market) FILTER (WHERE valid_from <= TIMESTAMP '{AS_OF}' AND valid_until >= TIMESTAMP '{AS_OF}') AS active_markets,
  min(price) FILTER (WHERE valid_from <= TIMESTAMP '{AS_OF}' AND valid_until >= TIMESTAMP '{AS_OF}') AS min_price,
  max(price) FILTER (WHERE valid_from <= TIMESTAMP '{AS_OF}' AND valid_until >= TIMESTAMP '{AS_OF}') AS max_price FROM prices GROUP BY product),
t AS (SELECT * FROM a WHERE market_count >= 2 ORDER BY active_markets DESC, offer_count DESC, product LIMIT 120)
SELECT t.product, market_count, offer_count, active_markets, min_price, max_price,
  CASE WHEN min_price > 0 THEN CAST(floor((max_price - min_price) / min_price * 100 * 10.0 + 0.5) AS DOUBLE) / 10.0 END AS spread_pct,
  coalesce(p_name, '—') AS name, coalesce(p_brand, '—') AS brand FROM t LEFT JOIN part ON product = p_partkey""",
)
def list_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of products, the 120 with most active markets; names join after the limit."""
    active = _active()
    a = prices(spark, sf_dir).groupBy("product").agg(
        F.count_distinct("market").alias("market_count"),
        F.count(F.lit(1)).alias("offer_count"),
        F.count_distinct(F.when(active, F.col("market"))).alias("active_markets"),
        F.min(F.when(active, F.col("price"))).alias("min_price"),
        F.max(F.when(active, F.col("price"))).alias("max_price"),
    )
    top = a.filter("market_count >= 2").orderBy(F.desc("active_markets"), F.desc("offer_count"), "product").limit(120)
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), "p_name", "p_brand")
    return top.join(names, "product", "left").select("product", "market_count", "offer_count", "active_markets", "min_price", "max_price", spread_pct(F.col("min_price"), F.col("max_price")).alias("spread_pct"), F.coalesce("p_name", F.lit("—")).alias("name"), F.coalesce("p_brand", F.lit("—")).alias("brand"))


@query("searched_products", f"""WITH {PRICES_SQL}, a AS (SELECT product, count(DISTINCT market) AS market_count, count(DISTINCT offer_id) AS offer_count FROM prices GROUP BY product) SELECT p_partkey AS product, p_name AS name, coalesce(market_count, 0) AS market_count, coalesce(offer_count, 0) AS offer_count FROM part LEFT JOIN a ON product = p_partkey WHERE contains(lower(p_name), 'blue') AND coalesce(market_count, 0) >= 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 80""")
def searched_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose name holds a text, with their coverage; the eighty newest."""
    from pricewell.operators.listing import contains_text

    found = contains_text(table(spark, sf_dir, "part"), "BLUE", "p_name").select(F.col("p_partkey").alias("product"), F.col("p_name").alias("name"), "p_retailprice")
    a = prices(spark, sf_dir).join(found.select("product"), "product", "left_semi").groupBy("product").agg(F.count_distinct("market").alias("market_count"), F.count_distinct("offer_id").alias("offer_count"))
    return found.join(a, "product").orderBy(F.desc("p_retailprice"), "product").limit(80).select("product", "name", "market_count", "offer_count")


@query(
    "price_board",
    f"""WITH {PRICES_SQL},
r AS (SELECT *, valid_from <= TIMESTAMP '{AS_OF}' AND valid_until >= TIMESTAMP '{AS_OF}' AS active FROM prices),
b AS (SELECT *, row_number() OVER (PARTITION BY product, market ORDER BY active DESC, created_at DESC, offer_id DESC) AS rn FROM r)
SELECT product, market, price, original, active, club, coalesce(s_name, '—') AS market_name,
  CASE WHEN original > 0 AND price < original THEN CAST(floor((original - price) / original * 100 * 10.0 + 0.5) AS DOUBLE) / 10.0 END AS discount_pct
FROM b LEFT JOIN supplier ON market = s_suppkey WHERE rn = 1""",
)
def price_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each product and market: the newest active price, else the newest."""
    p = prices(spark, sf_dir).withColumn("active", _active())
    board = latest_per_market(p, ["price", "original", "active", "club"], prefer_active=True)
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("market"), F.col("s_name").alias("market_name"))
    return board.join(names, "market", "left").withColumn("market_name", F.coalesce("market_name", F.lit("—"))).withColumn("discount_pct", discount_catalogue(F.col("original"), F.col("price")))


@query(
    "price_history",
    f"""WITH {PRICES_SQL} SELECT offer_id, product, coalesce(s_name, '—') AS market_name, price, strftime(created_at, '%Y-%m-%d') AS day
FROM (SELECT * FROM prices WHERE product = 1 ORDER BY created_at DESC, offer_id DESC LIMIT 200) LEFT JOIN supplier ON market = s_suppkey""",
)
def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 newest prices of one product with their market's name."""
    p = prices(spark, sf_dir).filter("product = 1").orderBy(F.desc("created_at"), F.desc("offer_id")).limit(200)
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("market"), "s_name")
    return p.join(names, "market", "left").select("offer_id", "product", F.coalesce("s_name", F.lit("—")).alias("market_name"), "price", F.date_format("created_at", "yyyy-MM-dd").alias("day"))




@query(
    "price_series_ffill",
    f"""WITH {PRICES_SQL},
d AS (SELECT CAST(unnest(generate_series(DATE '{START}', DATE '2001-09-29', INTERVAL 1 DAY)) AS DATE) AS day),
m AS (SELECT market FROM prices GROUP BY market ORDER BY count(*) DESC, market LIMIT 6),
own AS (SELECT p.* FROM prices p JOIN m USING (market)),
daily AS (SELECT CAST(created_at AS DATE) AS day, market, arg_max(price, (created_at, offer_id)) AS price FROM own WHERE created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '2001-09-30' GROUP BY ALL),
seed AS (SELECT market, arg_max(price, (created_at, offer_id)) AS price FROM own WHERE created_at < TIMESTAMP '{START}' GROUP BY market),
grid AS (SELECT d.day, m.market, daily.price FROM d CROSS JOIN m LEFT JOIN daily ON daily.day = d.day AND daily.market = m.market
  UNION ALL SELECT DATE '2001-08-30', market, price FROM seed)
SELECT * FROM (SELECT strftime(day, '%Y-%m-%d') AS day, market, last_value(price IGNORE NULLS) OVER (PARTITION BY market ORDER BY grid.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM grid) WHERE day >= '{START}'""",
)
def price_series_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty days of the six busiest markets: last price of the day, carried forward, begun with the last one before."""
    p = prices(spark, sf_dir).select("market", "created_at", "offer_id", "price")
    return _series(p, F.broadcast(top_groups(p, "market", 6).select("market")))  # six rows


@query(
    "price_timeseries",
    f"""WITH {PRICES_SQL},
w AS (SELECT *, CAST(created_at AS DATE) AS d FROM prices WHERE created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '2001-09-30'),
l AS (SELECT d, product, market, arg_max(price, (created_at, offer_id)) AS price FROM w GROUP BY ALL),
s AS (SELECT d, product, min(price) AS mn, max(price) AS mx FROM l GROUP BY ALL HAVING count(*) >= 2),
g AS (SELECT d, count(*) AS multi_count, avg((mx - mn) / mn * 100) FILTER (WHERE mn > 0) AS mean_s, median((mx - mn) / mn * 100) FILTER (WHERE mn > 0) AS median_s FROM s GROUP BY d),
c AS (SELECT d, avg(CASE WHEN club THEN coalesce(original, price) ELSE price END) AS public_avg, avg(price) FILTER (WHERE club) AS club_avg, count(price) FILTER (WHERE club) AS club_samples, count(*) AS public_samples FROM w GROUP BY d),
days AS (SELECT CAST(unnest(generate_series(DATE '{START}', DATE '2001-09-29', INTERVAL 1 DAY)) AS DATE) AS d)
SELECT strftime(days.d, '%Y-%m-%d') AS day, coalesce(multi_count, 0) AS multi_count,
  CAST(floor(coalesce(mean_s, 0) * 10.0 + 0.5) AS DOUBLE) / 10.0 AS mean_spread, CAST(floor(coalesce(median_s, 0) * 10.0 + 0.5) AS DOUBLE) / 10.0 AS median_spread,
  CAST(floor(coalesce(public_avg, 0) * 100.0 + 0.5) AS DOUBLE) / 100.0 AS public_avg, CAST(floor(coalesce(club_avg, 0) * 100.0 + 0.5) AS DOUBLE) / 100.0 AS club_avg,
  coalesce(club_samples, 0) AS club_samples, coalesce(public_samples, 0) AS public_samples
FROM days LEFT JOIN g ON g.d = days.d LEFT JOIN c ON c.d = days.d""",
)
def price_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median spread of products with several markets on a day; the average price for everyone against the members' one.

    A members' row gives its price to the members' mean, and its original price (or its price) to everyone's.
    """
    begin, end = (F.lit(x).cast("timestamp_ntz") for x in (START, "2001-09-30"))
    w = prices(spark, sf_dir).filter((F.col("created_at") >= begin) & (F.col("created_at") < end)).withColumn("day", F.to_date("created_at"))
    last = w.groupBy("day", "product", "market").agg(F.max_by("price", F.struct("created_at", "offer_id")).alias("price"))
    spread = last.groupBy("day", "product").agg(F.min("price").alias("mn"), F.max("price").alias("mx"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    pct = F.when(F.col("mn") > 0, (F.col("mx") - F.col("mn")) / F.col("mn") * 100)
    g = spread.groupBy("day").agg(F.count(F.lit(1)).alias("multi_count"), F.avg(pct).alias("mean_s"), F.median(pct).alias("median_s"))
    own, all_ = F.when(F.col("club"), F.col("price")), F.when(F.col("club"), F.coalesce("original", "price")).otherwise(F.col("price"))
    c = w.groupBy("day").agg(F.avg(all_).alias("public"), F.avg(own).alias("members"), F.count(own).alias("club_samples"), F.count(F.lit(1)).alias("public_samples"))
    days = calendar(spark, START, DAYS).join(g, "day", "left").join(c, "day", "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("multi_count", F.lit(0)).alias("multi_count"), half_up(zero(F.col("mean_s")), 1).alias("mean_spread"), half_up(zero(F.col("median_s")), 1).alias("median_spread"), half_up(zero(F.col("public")), 2).alias("public_avg"), half_up(zero(F.col("members")), 2).alias("club_avg"), F.coalesce("club_samples", F.lit(0)).alias("club_samples"), F.coalesce("public_samples", F.lit(0)).alias("public_samples"))


@query(
    "sku_timeseries",
    f"""WITH {PRICES_SQL},
w AS (SELECT *, CAST(created_at AS DATE) AS d FROM prices WHERE created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '2001-09-30'),
m AS (SELECT market, row_number() OVER (ORDER BY n DESC, market) AS series_rank FROM (SELECT market, count(*) AS n FROM w GROUP BY market ORDER BY n DESC, market LIMIT 6)),
days AS (SELECT CAST(unnest(generate_series(DATE '{START}', DATE '2001-09-29', INTERVAL 1 DAY)) AS DATE) AS d),
c AS (SELECT d, market, count(*) AS n FROM w GROUP BY ALL)
SELECT strftime(days.d, '%Y-%m-%d') AS day, m.market, coalesce(c.n, 0) AS offers, CAST((series_rank - 1) % 6 AS INTEGER) AS color FROM days CROSS JOIN m LEFT JOIN c ON c.d = days.d AND c.market = m.market""",
)
def sku_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers a day of the six busiest markets, days without any as zero."""
    begin, end = (F.lit(x).cast("timestamp_ntz") for x in (START, "2001-09-30"))
    w = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("market"), F.col("l_shipdate").alias("ts")).filter((F.col("ts") >= begin) & (F.col("ts") < end))
    counted = w.groupBy(F.to_date("ts").alias("day"), "market").agg(F.count(F.lit(1)).alias("offers"))
    top = top_groups(w, "market", 6).select("market", ((F.col("rank") - 1) % 6).cast("int").alias("color"))
    grid = calendar(spark, START, DAYS).crossJoin(F.broadcast(top))  # 30 x 6 rows
    return grid.join(counted, ["day", "market"], "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "market", F.coalesce("offers", F.lit(0)).alias("offers"), "color")


@query(
    "extreme_spread",
    f"""WITH {PRICES_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY product, market ORDER BY created_at DESC, offer_id DESC) AS rn FROM prices WHERE valid_from <= TIMESTAMP '{AS_OF}' AND valid_until >= TIMESTAMP '{AS_OF}'),
a AS (SELECT product, count(*) AS markets, min(price) AS mn, max(price) AS mx FROM r WHERE rn = 1 GROUP BY product HAVING count(*) >= 2)
SELECT product, markets, CAST(floor((mx - mn) / mn * 100 * 10.0 + 0.5) AS DOUBLE) / 10.0 AS spread_pct FROM a WHERE mn > 0 AND (mx - mn) / mn * 100 > 40 ORDER BY spread_pct DESC, product LIMIT 40""",
)
def extreme_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose active prices differ by more than 40 per cent across markets; the 40 widest."""
    latest = latest_per_market(prices(spark, sf_dir).filter(_active()), ["price"])
    a = latest.groupBy("product").agg(F.count(F.lit(1)).alias("markets"), F.min("price").alias("mn"), F.max("price").alias("mx")).filter("markets >= 2 AND mn > 0 AND (mx - mn) / mn * 100 > 40")
    return a.select("product", "markets", spread_pct(F.col("mn"), F.col("mx")).alias("spread_pct")).orderBy(F.desc("spread_pct"), "product").limit(40)


@query(
    "reanalyze_diff",
    f"""WITH {PRICES_SQL},
b AS (SELECT product, market, arg_max(price, (created_at, offer_id)) AS price_before FROM prices WHERE created_at < TIMESTAMP '2001-01-01' GROUP BY ALL),
a AS (SELECT product, market, arg_max(price, (created_at, offer_id)) AS price_after FROM prices WHERE created_at >= TIMESTAMP '2001-01-01' GROUP BY ALL)
SELECT product, market, price_before, price_after, CAST(floor((price_after - price_before) * 100.0 + 0.5) AS DOUBLE) / 100.0 AS change FROM a JOIN b USING (product, market) WHERE price_before <> price_after""",
)
def reanalyze_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products and markets whose last price before and after a day differ."""
    from pricewell.operators.joins import price_changes

    p, cut = prices(spark, sf_dir), F.lit("2001-01-01").cast("timestamp_ntz")
    after = latest_per_market(p.filter(F.col("created_at") >= cut), ["price"])
    found = price_changes(p.filter(F.col("created_at") < cut), after, ["product", "market"], "price", F.struct("created_at", "offer_id"))
    return found.select("product", "market", "price_before", "price_after", half_up(F.col("price_after") - F.col("price_before"), 2).alias("change"))


@query(
    "home_offers",
    f"""WITH {PRICES_SQL} SELECT offer_id, product, market, price, CAST(floor((original - price) / original * 100 * 10.0 + 0.5) AS DOUBLE) / 10.0 AS discount_pct FROM prices
WHERE valid_from <= TIMESTAMP '{AS_OF}' AND valid_until >= TIMESTAMP '{AS_OF}' AND original > 0 AND price < original ORDER BY discount_pct DESC, CASE WHEN club THEN original ELSE price END, offer_id LIMIT 12""",
)
def home_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve active offers with the largest discount, then the lowest price for everyone."""
    p = prices(spark, sf_dir).filter(_active()).withColumn("discount_pct", discount_catalogue(F.col("original"), F.col("price"))).filter("discount_pct IS NOT NULL")
    return p.orderBy(F.desc("discount_pct"), F.when(F.col("club"), F.col("original")).otherwise(F.col("price")), "offer_id").limit(12).select("offer_id", "product", "market", "price", "discount_pct")


@query(
    "club_prices",
    f"""WITH {PRICES_SQL} SELECT market, count(*) AS offers, count(*) FILTER (WHERE club) AS club_offers,
CAST(floor(avg(CASE WHEN club THEN original ELSE price END) * 100.0 + 0.5) AS DOUBLE) / 100.0 AS avg_ranking_price FROM prices GROUP BY market""",
)
def club_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per market: offers, members' offers, and the mean price that everyone can pay."""
    from pricewell.functions.semantics import ranking_price

    return prices(spark, sf_dir).groupBy("market").agg(F.count(F.lit(1)).alias("offers"), F.count_if("club").alias("club_offers"), half_up(F.avg(ranking_price(F.col("price"), F.col("original"), F.col("club"))), 2).alias("avg_ranking_price"))




@query(
    "price_timeseries_summary",
    f"""WITH {PRICES_SQL}, w AS (SELECT *, CAST(created_at AS DATE) AS d FROM prices WHERE created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '2001-09-30'),
l AS (SELECT d, product, market, arg_max(price, (created_at, offer_id)) AS price FROM w GROUP BY ALL),
s AS (SELECT d, product, min(price) AS mn, max(price) AS mx FROM l GROUP BY ALL HAVING count(*) >= 2),
g AS (SELECT d, CAST(floor(coalesce(avg((mx - mn) / mn * 100) FILTER (WHERE mn > 0), 0) * 10.0 + 0.5) AS BIGINT) AS spread FROM s GROUP BY d),
c AS (SELECT d, CAST(floor(avg(CASE WHEN club THEN coalesce(original, price) ELSE price END) * 100.0 + 0.5) AS BIGINT) AS everyone, CAST(floor(avg(price) FILTER (WHERE club) * 100.0 + 0.5) AS BIGINT) AS members
  FROM w GROUP BY d HAVING count(*) FILTER (WHERE club) > 0)
SELECT coalesce((SELECT floor(sum(spread) / count(*)::DOUBLE + 0.5) FROM g), 0) / 10.0::DOUBLE AS mean_spread, coalesce(floor(sum(everyone) / count(*)::DOUBLE + 0.5), 0) / 100.0::DOUBLE AS public_avg, coalesce(floor(sum(members) / count(*)::DOUBLE + 0.5), 0) / 100.0::DOUBLE AS club_avg, count(*) AS days FROM c""",
)
def price_timeseries_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of daily means, which are rounded already: the spread over days with a product in several markets, both prices over days with members' prices."""
    d = price_timeseries(spark, sf_dir)
    some = F.col("club_samples") > 0
    # sums of whole tenths and cents, so that no order of summing decides a tie
    whole = lambda cond, name, places: F.floor(F.sum(F.when(cond, F.round(F.col(name) * 10**places).cast("long"))) / F.count_if(cond) + 0.5)
    over = lambda cond, name, places: F.when(F.count_if(cond) > 0, whole(cond, name, places) / 10.0**places).otherwise(F.lit(0.0)).alias(name)
    return d.agg(over(F.col("multi_count") > 0, "mean_spread", 1), over(some, "public_avg", 2), over(some, "club_avg", 2), F.count_if(some).alias("days"))
