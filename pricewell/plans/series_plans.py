"""Baskets and chart series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.functions.semantics import half_up, ranking_price
from pricewell.operators.basket import baskets, best_offers, best_single, list_baskets, ranked, split_summary, split_two
from pricewell.operators.series import anchor_slope, axis_domains, decimate, ohlc, project, slope, stack, tallest
from pricewell.plans.frames import cte, frame, half, norm
from pricewell.registry import query
from pricewell.sources.scratch import kept
from pricewell.sources.tables import PRICES_SQL, prices, table

#: item, text, quantity, product and offer that it names (if any)
LIST = [("i1", "blue", 2.0, None, None), ("i2", "red", 1.0, None, None), ("i3", "small", 3.0, 7, None), ("i4", "bolt", 1.0, None, None)]
_ITEMS_SQL = ", ".join(f"('{i}', '{q}', {n}::DOUBLE, {'NULL::BIGINT' if p is None else p})" for i, q, n, p, _ in LIST)
_BASKET_SQL = f"""WITH {PRICES_SQL}, items AS (SELECT * FROM (VALUES {_ITEMS_SQL}) t(item, query, quantity, asked)),
offers AS (SELECT offer_id, market, product, p_name AS name, CASE WHEN club THEN original ELSE price END AS ranking_price FROM prices JOIN part ON product = p_partkey WHERE valid_from <= TIMESTAMP '2001-10-01' AND valid_until >= TIMESTAMP '2001-10-01'),
met AS (SELECT * FROM items, offers WHERE coalesce(asked = product, false) OR list_bool_and(list_transform(string_split(query, ' '), lambda x: contains(lower(name), x)))),
best AS (SELECT item, market, arg_min(offer_id, (ranking_price, offer_id)) AS offer_id, arg_min(ranking_price * quantity, (ranking_price, offer_id)) AS line_total FROM met GROUP BY ALL),
b AS (SELECT s_suppkey AS market, {half('coalesce(sum(line_total), 0)', 2)} AS total, {len(LIST)} - count(item) AS missing, {half(f'count(item) / {len(LIST)}.0 * 100', 1)} AS coverage_pct, count(item) = {len(LIST)} AS complete FROM supplier LEFT JOIN best ON market = s_suppkey GROUP BY 1),
r AS (SELECT * FROM b WHERE complete OR NOT (SELECT bool_or(complete) FROM b)),
one AS (SELECT market, total, missing, complete, CASE WHEN complete THEN greatest(0.0, {half('(SELECT max(total) FROM b WHERE complete) - total', 2)}) ELSE 0.0 END AS savings_vs_worst FROM r ORDER BY missing, total, market LIMIT 1),
f AS (SELECT item, arg_min(market, (line_total, market)) AS own FROM best GROUP BY item), k AS (SELECT own AS market, row_number() OVER (ORDER BY count(*) DESC, min(item)) AS rk FROM f GROUP BY own ORDER BY rk LIMIT 2),
s AS (SELECT best.item, arg_min(best.market, (best.market <> own, line_total, rk)) AS market, {half('arg_min(line_total, (best.market <> own, line_total, rk))', 2)} AS line_total FROM best JOIN k ON k.market = best.market JOIN f ON f.item = best.item WHERE (SELECT count(*) FROM f) = {len(LIST)} GROUP BY best.item)"""


def _items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIST, "item string, query string, quantity double, product long, offer string")


def _markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("market"))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2001-10-01").cast("timestamp_ntz")
    p = prices(spark, sf_dir).filter((F.col("valid_from") <= at) & (F.col("valid_until") >= at))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), F.col("p_name").alias("name"))
    offers = p.join(names, "product").select("offer_id", "market", "product", "name", ranking_price(F.col("price"), F.col("original"), F.col("club")).alias("ranking_price"))
    return best_offers(_items(spark), offers)


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baskets(_best(spark, sf_dir), len(LIST), _markets(spark, sf_dir))


@query("basket_compare", f"{_BASKET_SQL} SELECT * FROM b")
def basket_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a list costs at each market, those that have nothing of it too."""
    return _baskets(spark, sf_dir)


@query("basket_ranked", f"{_BASKET_SQL} SELECT market, total, missing FROM r ORDER BY missing, total, market LIMIT 20")
def basket_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best of the complete markets, or of all where none is complete."""
    return ranked(_baskets(spark, sf_dir)).limit(20).select("market", "total", "missing")


@query("basket_best", f"{_BASKET_SQL} SELECT * FROM one")
def basket_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_single(_baskets(spark, sf_dir))


@query("basket_split", f"{_BASKET_SQL} SELECT * FROM s")
def basket_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_two(_best(spark, sf_dir), len(LIST))


@query("basket_split_total", f"{_BASKET_SQL}, t AS (SELECT count(DISTINCT market) AS stores, count(*) AS lines, {half('sum(line_total)', 2)} AS split_total FROM s HAVING count(*) > 0) SELECT stores, lines, split_total, CASE WHEN one.complete AND one.total > split_total THEN {half('one.total - split_total', 2)} ELSE 0.0 END AS savings_vs_best_single FROM t, one")
def basket_split_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the split costs, and what it saves against the best single market."""
    best = kept(_best(spark, sf_dir), "best-offers")
    return split_summary(split_two(best, len(LIST)), best_single(kept(baskets(best, len(LIST), _markets(spark, sf_dir)), "baskets")))


@query("basket_lines", f"{_BASKET_SQL}, g AS (SELECT s_suppkey AS market, item FROM supplier, items) SELECT g.item, g.market, {half('line_total', 2)} AS line_total, offer_id IS NULL AS missing FROM g LEFT JOIN best ON best.item = g.item AND best.market = g.market")
def basket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list's lines at every market, missing ones too."""
    from pricewell.operators.basket import lines

    return lines(_best(spark, sf_dir), _items(spark), _markets(spark, sf_dir)).select("item", "market", half_up(F.col("line_total"), 2).alias("line_total"), "missing")


_LISTS_SQL = f"""items AS (SELECT l_orderkey AS list_id, l_linenumber AS item, l_quantity AS quantity, CASE WHEN l_linenumber = 7 THEN CAST(l_partkey AS STRING) END AS offer,
  CASE l_linenumber WHEN 1 THEN p_name WHEN 2 THEN upper(substr(p_name, 2, 3)) WHEN 3 THEN regexp_replace(p_name, '^(.*) (.*)$', '$2 x $1') WHEN 4 THEN substr(p_name, 1, 2) || '-' || substr(p_name, length(p_name) - 2, 3) WHEN 5 THEN 'no such ' || p_name WHEN 6 THEN 'a' ELSE '' END AS query
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, sum(l_quantity) AS l_quantity FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) JOIN {{part}} ON l_partkey = p_partkey)"""


@query(
    "all_lists_compare",
    f"""WITH {cte('offers')}, {_LISTS_SQL.format(lineitem='lineitem', part='part').replace('$2 x $1', chr(92) + '2 x ' + chr(92) + '1')},
o AS (SELECT *, coalesce(CASE WHEN eligibility <> 'ALL_CUSTOMERS' THEN original_price END, price) AS rank_price FROM offers WHERE validation_status = 'validated'),
names AS (SELECT DISTINCT {norm('name')} AS t FROM o), q AS (SELECT DISTINCT query, list_filter(string_split({norm('query')}, ' '), lambda x: length(x) >= 2) AS toks FROM items),
hits AS (SELECT query, t FROM q, names WHERE len(toks) > 0 AND list_bool_and(list_transform(toks, lambda x: contains(t, x)))),
per_query AS (SELECT query, supermarket_id AS market, min(rank_price) AS p FROM hits JOIN o ON {norm('name')} = t GROUP BY ALL),
met AS (SELECT list_id, item, items.quantity, market, p FROM items JOIN per_query USING (query) UNION ALL SELECT list_id, item, items.quantity, supermarket_id, rank_price FROM items JOIN o ON o.id = items.offer),
best AS (SELECT list_id, item, market, min(p) * any_value(quantity) AS line_total FROM met GROUP BY ALL), n AS (SELECT list_id, count(*) AS n FROM items GROUP BY 1)
SELECT list_id, market, {half('sum(line_total)', 2)} AS total, any_value(n) - count(*) AS missing, any_value(n) = count(*) AS complete FROM best JOIN n USING (list_id) GROUP BY list_id, market""",
)
def all_lists_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every user's list costs at every market: whole names, parts of words, words in another order, named offers."""
    items = spark.sql(f"WITH {_LISTS_SQL} SELECT * FROM items", lineitem=table(spark, sf_dir, "lineitem"), part=table(spark, sf_dir, "part"))
    c = F.col
    price = ranking_price(c("price"), c("original_price"), F.coalesce(c("eligibility") != "ALL_CUSTOMERS", F.lit(False)))
    offers = frame(spark, sf_dir, "offers").filter("validation_status = 'validated'").select(c("id").alias("offer_id"), c("supermarket_id").alias("market"), "name", price.alias("ranking_price"))
    return list_baskets(items, offers)


_CANDLES = "c AS (SELECT user_id, ts, event_id, value AS open, value + event_id % 5 AS high, value - event_id % 3 AS low, value + event_id % 2 AS close FROM events)"


@query(
    "ohlc",
    f"""WITH {_CANDLES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM c),
b AS (SELECT *, CASE WHEN 8 >= n THEN k ELSE (SELECT max(i) FROM range(0, 8) t(i) WHERE floor(i * (n / 8.0::DOUBLE)) <= k) END::BIGINT AS bucket FROM r) SELECT user_id, bucket, arg_min(open, k) AS open, max(high) AS high, min(low) AS low, arg_max(close, k) AS close FROM b GROUP BY ALL""",
)
def ohlc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles of each worker, at most eight."""
    k, v = F.col("event_id"), F.col("value")
    c = table(spark, sf_dir, "events").select("user_id", "ts", k, v.alias("open"), (v + k % 5).alias("high"), (v - k % 3).alias("low"), (v + k % 2).alias("close"))
    return ohlc(c, "user_id", ["ts", "event_id"], 8)


_DAILY_SQL = "d AS (SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS x, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY ALL)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return e.select("event_type", F.datediff("d", F.lit("2024-01-01")).cast("long").alias("x"), "y")


@query("regression_slope", f"WITH {_DAILY_SQL} SELECT event_type, CAST(floor(coalesce(regr_slope(y, x), 0) * 1000000.0 + 0.5) AS DOUBLE) / 1000000.0 AS slope FROM d GROUP BY event_type")
def regression_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir).groupBy("event_type").agg(half_up(slope(F.col("y"), F.col("x")), 6).alias("slope"))


@query("regression_projection", f"WITH {_DAILY_SQL}, f AS (SELECT event_type, coalesce(regr_slope(y, x), 0) AS s, max(x) AS x0, arg_max(y, x) AS y0 FROM d GROUP BY event_type) SELECT event_type, CAST(x0 + k AS DOUBLE) AS x, CAST(floor((y0 + s * k) * 10000.0 + 0.5) AS DOUBLE) / 10000.0 AS projected FROM f, (SELECT unnest(range(1, 7)) AS k)")
def regression_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(_daily(spark, sf_dir), "event_type", "x", "y")


@query("stack_share", f"WITH {_DAILY_SQL} SELECT event_type, x, y, CAST(floor(coalesce(sum(y) OVER (PARTITION BY x ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 10000.0 + 0.5) AS DOUBLE) / 10000.0 AS base, CAST(floor(y / sum(y) OVER (PARTITION BY x) * 1000000.0 + 0.5) AS DOUBLE) / 1000000.0 AS share FROM d")
def stack_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack(_daily(spark, sf_dir), "x", "event_type", "y")


_MOST = 16


@query(
    "lttb",
    f"""WITH RECURSIVE e AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS j, count(*) OVER (PARTITION BY user_id) AS n, value FROM events), y AS (SELECT u, j, n, coalesce(value, j) AS y FROM e), s AS (SELECT DISTINCT u, n, (n - 2) / {_MOST - 2}.0::DOUBLE AS size FROM y WHERE n > {_MOST}),
b AS (SELECT u, n, i, CAST(floor((i + 1) * size) + 1 AS BIGINT) AS lo, least(CAST(floor((i + 2) * size) + 1 AS BIGINT), n - 1) AS hi, CAST(floor((i + 2) * size) + 1 AS BIGINT) AS nlo, least(CAST(floor((i + 3) * size) + 1 AS BIGINT), n) AS nhi FROM s, range(0, {_MOST - 2}) t(i)),
m AS (SELECT b.u, b.i, b.n, lo, hi, coalesce(avg(CAST(y.j AS DOUBLE)), n1.j) AS mx, coalesce(avg(y.y), n1.y) AS my FROM b JOIN y n1 ON n1.u = b.u AND n1.j = b.n - 1 LEFT JOIN y ON y.u = b.u AND y.j >= nlo AND y.j < nhi GROUP BY b.u, b.i, b.n, lo, hi, n1.j, n1.y),
p AS (SELECT u, -1::BIGINT AS i, 0::BIGINT AS j FROM s UNION ALL SELECT m.u, m.i, coalesce((SELECT arg_max(c.j, (abs((p.j - mx) * (c.y - a.y) - (p.j - c.j) * (my - a.y)) * 0.5, -c.j)) FROM y c WHERE c.u = m.u AND c.j >= lo AND c.j < hi), lo) FROM p JOIN m ON m.u = p.u AND m.i = p.i + 1 JOIN y a ON a.u = p.u AND a.j = p.j)
SELECT u AS user_id, i + 1 AS pick, j AS place FROM p UNION ALL SELECT u, {_MOST - 1}, n - 1 FROM s UNION ALL SELECT u, j, j FROM y WHERE n <= {_MOST}""",
)
def lttb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each worker's values in order at sixteen points that keep the line's shape; a pick depends on the one before."""
    return decimate(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", _MOST)


@query("anchor_slopes", f"WITH {_DAILY_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY x DESC) AS r FROM d WHERE x <= 20) SELECT event_type, {half('coalesce((max(y) FILTER (WHERE r = 1) - max(y) FILTER (WHERE r = 2)) / nullif(max(x) FILTER (WHERE r = 1) - max(x) FILTER (WHERE r = 2), 0), 0)', 4)} AS slope FROM w GROUP BY event_type")
def anchor_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope of the last segment up to day 20."""
    return anchor_slope(_daily(spark, sf_dir), "event_type", "x", "y", F.lit(20)).select("event_type", half_up(F.col("slope"), 4).alias("slope"))


@query("projection_modes", f"""WITH {_DAILY_SQL}, l AS (SELECT event_type, max(x) AS x0, arg_max(y, x) AS y0, coalesce(regr_slope(y, x), 0) AS s, list(y ORDER BY x) AS ys, list(x ORDER BY x) AS xs FROM d GROUP BY event_type), t AS (SELECT *, coalesce((ys[-1] - ys[-2]) / nullif(xs[-1] - xs[-2], 0), 0) AS s2 FROM l)
SELECT 'endpoints' AS mode, event_type, CAST(x0 + k * 2 AS DOUBLE) AS x, {half('y0 + s * k * 2', 4)} AS projected FROM t, (VALUES (0), (6)) v(k) UNION ALL SELECT 'last', event_type, CAST(x0 + k AS DOUBLE), {half('y0 + s2 * k', 4)} FROM t, range(1, 4) r(k) UNION ALL SELECT 'target', event_type, CAST(x0 + k AS DOUBLE), {half('CASE WHEN k = 0 THEN y0 ELSE 100 END', 4)} FROM t, (VALUES (0), (6)) v(k)""")
def projection_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection by its two ends, along the last segment, and to a target."""
    d = _daily(spark, sf_dir)
    modes = {"endpoints": dict(path="endpoints", interval=2.0), "last": dict(steps=3, method="last"), "target": dict(target=100.0)}
    out = [project(d, "event_type", "x", "y", **kw).select(F.lit(m).alias("mode"), "event_type", "x", "projected") for m, kw in modes.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("axis_domains", f"WITH {_DAILY_SQL} SELECT x % 3 AS axis, min(least(y, x)) AS low, max(greatest(y, x)) AS high FROM d GROUP BY 1")
def axis_domains_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of all series on each axis."""
    d = _daily(spark, sf_dir).select((F.col("x") % 3).alias("axis"), F.col("x").cast("double").alias("x"), "y")
    return axis_domains(d, "axis", ["x", "y"])


@query("tallest_bar", f"WITH {_DAILY_SQL} SELECT max(coalesce(y, 0) + coalesce(x, 0)) AS tallest FROM d")
def tallest_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallest(_daily(spark, sf_dir), ["y", "x"])


@query("chart_extent", f"WITH {_DAILY_SQL} SELECT min(y) AS low, max(y) AS high, {half('min(y) - (max(y) - min(y)) * 0.05::DOUBLE', 2)} AS domain_low, {half('max(y) + (max(y) - min(y)) * 0.05::DOUBLE', 2)} AS domain_high, 0.0::DOUBLE AS axis_low, {half('max(y) * 1.1::DOUBLE', 2)} AS axis_high FROM d")
def chart_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricewell.operators.series import extent

    return extent(_daily(spark, sf_dir), "y").withColumns({c: half_up(F.col(c), 2) for c in ("domain_low", "domain_high", "axis_low", "axis_high")})
