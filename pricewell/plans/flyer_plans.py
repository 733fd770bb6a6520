"""Flyers seen through orders: lists, lifecycle, scopes, paging, networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewell.functions.geo import haversine_km
from pricewell.functions.semantics import half_up
from pricewell.operators.filters import expirable, flyer_active, flyer_current
from pricewell.operators.joins import applies_to, semi_or_all
from pricewell.operators.keyed import last_n, offset_page
from pricewell.registry import query
from pricewell.sources.tables import table

NOW = "2000-06-01"
_FLYERS_SQL = """flyers AS (SELECT o_orderkey AS flyer_id, o_custkey % 100 + 1 AS market, o_orderdate AS valid_from, o_orderdate + INTERVAL 7 DAY AS valid_until,
  CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'downloaded' ELSE 'failed' END AS status, o_totalprice AS total FROM orders)"""


def flyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "downloaded").otherwise("failed")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("flyer_id"), (F.col("o_custkey") % 100 + 1).alias("market"), F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("valid_until"), status.alias("status"), F.col("o_totalprice").alias("total"))


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(
    "lifecycle",
    f"""WITH {_FLYERS_SQL}, n AS (SELECT *, CASE WHEN valid_until < TIMESTAMP '{NOW}' AND status NOT IN ('expired', 'failed', 'downloading', 'processing') THEN 'expired' ELSE status END AS new_status FROM flyers)
SELECT status, new_status, count(*) AS flyers, count(*) FILTER (WHERE new_status = 'expired' AND valid_until <= TIMESTAMP '{NOW}' - INTERVAL 30 DAY) AS purgeable,
  count(*) FILTER (WHERE valid_until BETWEEN TIMESTAMP '{NOW}' AND TIMESTAMP '{NOW}' + INTERVAL 24 HOUR AND new_status IN ('processed', 'downloaded')) AS near_expiry FROM n GROUP BY ALL""",
)
def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly sweep: what expires, what may be purged, what ends within a day."""
    from pricewell.operators.filters import near_expiry, purgeable

    n = flyers(spark, sf_dir).withColumn("new_status", F.when(expirable(F.col("status"), F.col("valid_until"), _now()), "expired").otherwise(F.col("status")))
    return n.groupBy("status", "new_status").agg(F.count(F.lit(1)).alias("flyers"), F.count_if(purgeable(F.col("new_status"), F.col("valid_until"), _now())).alias("purgeable"), F.count_if(near_expiry(F.col("new_status"), F.col("valid_until"), _now(), 24)).alias("near_expiry"))


@query(
    "flyer_status_kpis",
    f"""WITH {_FLYERS_SQL} SELECT count(*) AS flyers, count(*) FILTER (WHERE status NOT IN ('expired', 'failed') AND valid_until >= TIMESTAMP '{NOW}') AS active,
  count(*) FILTER (WHERE status NOT IN ('expired', 'failed') AND valid_from <= TIMESTAMP '{NOW}' AND valid_until >= TIMESTAMP '{NOW}') AS current_now, count(DISTINCT market) AS markets FROM flyers""",
)
def flyer_status_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active and current flyers: two predicates that differ in the beginning of the window."""
    f = flyers(spark, sf_dir)
    return f.agg(F.count(F.lit(1)).alias("flyers"), F.count_if(flyer_active(F.col("status"), F.col("valid_until"), _now())).alias("active"), F.count_if(flyer_current(F.col("status"), F.col("valid_from"), F.col("valid_until"), _now())).alias("current_now"), F.count_distinct("market").alias("markets"))


@query(
    "flyer_list_counts",
    f"""WITH {_FLYERS_SQL}, t AS (SELECT * FROM flyers ORDER BY valid_from DESC, flyer_id LIMIT 100),
c AS (SELECT l_orderkey, count(*) AS offers, count(DISTINCT l_linenumber) AS pages FROM lineitem WHERE l_orderkey IN (SELECT flyer_id FROM t) GROUP BY 1)
SELECT flyer_id, market, status, coalesce(offers, 0) AS offers, coalesce(pages, 0) AS pages, strftime(valid_until + INTERVAL 30 DAY, '%Y-%m-%d') AS retention_day FROM t LEFT JOIN c ON flyer_id = l_orderkey""",
)
def flyer_list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest flyers with their offers and pages; counting comes after the limit."""
    top = flyers(spark, sf_dir).orderBy(F.desc("valid_from"), "flyer_id").limit(100)
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("flyer_id"), "l_linenumber")
    c = li.join(top.select("flyer_id"), "flyer_id", "left_semi").groupBy("flyer_id").agg(F.count(F.lit(1)).alias("offers"), F.count_distinct("l_linenumber").alias("pages"))
    return top.join(c, "flyer_id", "left").select("flyer_id", "market", "status", F.coalesce("offers", F.lit(0)).alias("offers"), F.coalesce("pages", F.lit(0)).alias("pages"), F.date_format(F.col("valid_until") + F.expr("INTERVAL 30 DAYS"), "yyyy-MM-dd").alias("retention_day"))


@query(
    "array_scope_join",
    """WITH f AS (SELECT o_orderkey AS flyer_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN CAST([] AS BIGINT[]) ELSE [o_custkey % 10, o_custkey % 7] END AS stores FROM orders)
SELECT flyer_id FROM f WHERE stores IS NULL OR len(stores) = 0 OR list_has_any(stores, [CAST(3 AS BIGINT), CAST(8 AS BIGINT)])""",
)
def array_scope_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flyers that apply to some of the chosen stores: those without stores apply everywhere."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    scope = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.array().cast("array<bigint>")).otherwise(F.array(c % 10, c % 7))
    f = table(spark, sf_dir, "orders").select(k.alias("flyer_id"), scope.alias("stores"))
    return f.filter(applies_to(F.col("stores"), F.array(F.lit(3).cast("bigint"), F.lit(8).cast("bigint")))).select("flyer_id")


@query(
    "favorites_semi_fallback",
    """WITH fav AS (SELECT DISTINCT s_suppkey AS k FROM supplier WHERE s_acctbal > 5000), m AS (SELECT c_custkey, c_custkey % 100 + 1 AS k, c_mktsegment FROM customer),
h AS (SELECT count(*) AS n FROM m WHERE k IN (SELECT k FROM fav)) SELECT c_custkey, c_mktsegment FROM m, h WHERE h.n = 0 OR k IN (SELECT k FROM fav)""",
)
def favorites_semi_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of favourite markets, or all rows when no favourite has any."""
    m = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 100 + 1).alias("k"), "c_mktsegment")
    fav = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("k"))
    return semi_or_all(m, fav, "k").select("c_custkey", "c_mktsegment")


@query(
    "store_distance",
    """WITH s AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE -3.7 - (c_custkey % 50) / 100.0::DOUBLE END AS lat, -38.5 - (c_custkey % 37) / 100.0::DOUBLE AS lng FROM customer),
d AS (SELECT *, 2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - -3.73) / 2), 2) + cos(radians(-3.73)) * cos(radians(lat)) * pow(sin(radians(lng - -38.52) / 2), 2))) AS km FROM s)
SELECT c_custkey, c_mktsegment = 'BUILDING' AS favorite, CAST(floor(km * 10.0 + 0.5) AS DOUBLE) / 10.0 AS km FROM d ORDER BY favorite DESC, d.km ASC NULLS LAST, c_custkey LIMIT 50""",
)
def store_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty stores nearest to a point, favourites first, unknown distances last."""
    k = F.col("c_custkey")
    lat = F.when(k % 9 == 0, F.lit(None).cast("double")).otherwise(F.lit(-3.7) - (k % 50) / F.lit(100.0))
    s = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_mktsegment") == "BUILDING").alias("favorite"), haversine_km(F.lit(-3.73), F.lit(-38.52), lat, F.lit(-38.5) - (k % 37) / F.lit(100.0)).alias("d"))
    return s.orderBy(F.desc("favorite"), F.asc_nulls_last("d"), "c_custkey").limit(50).select("c_custkey", "favorite", half_up(F.col("d"), 1).alias("km"))


@query("offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def offset_page_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offset_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("last_n", "SELECT * FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)")
def last_n_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_n(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 20).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 25")
def keyset_page_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricewell.operators.keyed import keyset_page

    return keyset_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500)


@query(
    "network_list",
    f"""WITH {_FLYERS_SQL}, a AS (SELECT market, count(*) AS flyers, arg_max(flyer_id, (valid_until, flyer_id)) AS newest, min(valid_until) FILTER (WHERE valid_until >= TIMESTAMP '{NOW}') AS next_expiry FROM flyers GROUP BY market),
o AS (SELECT l_suppkey AS market, count(*) AS offers FROM lineitem GROUP BY 1)
SELECT s_suppkey AS market, s_name AS name, n_name AS nation, r_name AS region, coalesce(flyers, 0) AS flyers, coalesce(offers, 0) AS offers, newest, strftime(next_expiry, '%Y-%m-%d') AS next_expiry_day
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN a ON a.market = s_suppkey LEFT JOIN o ON o.market = s_suppkey""",
)
def network_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks with counts of flyers and offers, the newest flyer and the next expiry."""
    f = flyers(spark, sf_dir)
    a = f.groupBy("market").agg(F.count(F.lit(1)).alias("flyers"), F.max_by("flyer_id", F.struct("valid_until", "flyer_id")).alias("newest"), F.min(F.when(F.col("valid_until") >= _now(), F.col("valid_until"))).alias("next"))
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("market")).agg(F.count(F.lit(1)).alias("offers"))
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    s = s.select(F.col("s_suppkey").alias("market"), F.col("s_name").alias("name"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return s.join(a, "market", "left").join(o, "market", "left").select("market", "name", "nation", "region", F.coalesce("flyers", F.lit(0)).alias("flyers"), F.coalesce("offers", F.lit(0)).alias("offers"), "newest", F.date_format("next", "yyyy-MM-dd").alias("next_expiry_day"))


@query(
    "networks_at_risk",
    f"""WITH {_FLYERS_SQL}, a AS (SELECT market, bool_or(status = 'failed') AS failed, max(valid_until) < TIMESTAMP '{NOW}' AS over FROM flyers GROUP BY market)
SELECT count(*) AS at_risk FROM (SELECT s_suppkey FROM supplier LEFT JOIN a ON market = s_suppkey WHERE failed OR over OR market IS NULL)""",
)
def networks_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = flyers(spark, sf_dir).groupBy("market").agg(F.bool_or(F.col("status") == "failed").alias("failed"), (F.max("valid_until") < _now()).alias("over"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("market")).join(a.withColumn("known", F.lit(True)), "market", "left")
    return s.filter("failed OR over OR known IS NULL").agg(F.count(F.lit(1)).alias("at_risk"))


@query(
    "duplicate_flyers",
    """WITH h AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) SELECT o_orderkey, rn > 1 AS duplicate FROM h""",
)
def duplicate_flyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By market and content: the first stays, later ones are marked."""
    w = Window.partitionBy("o_custkey", "o_orderpriority", "o_orderstatus").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.row_number().over(w) > 1).alias("duplicate"))


@query(
    "validity_repair",
    f"""WITH {_FLYERS_SQL} SELECT flyer_id, CASE WHEN flyer_id % 3 = 0 THEN NULL ELSE strftime(valid_until + INTERVAL 3 DAY, '%Y-%m-%d') END AS new_until, CASE WHEN status = 'failed' THEN status WHEN valid_until + INTERVAL 3 DAY >= TIMESTAMP '{NOW}' THEN 'processed' ELSE 'expired' END AS new_status FROM flyers""",
)
def validity_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New validity ends; a flyer that is valid again is no longer expired."""
    end = F.col("valid_until") + F.expr("INTERVAL 3 DAYS")
    status = F.when(F.col("status") == "failed", F.col("status")).when(end >= _now(), "processed").otherwise("expired")
    return flyers(spark, sf_dir).select("flyer_id", F.when(F.col("flyer_id") % 3 != 0, F.date_format(end, "yyyy-MM-dd")).alias("new_until"), status.alias("new_status"))
