"""Catalogue upkeep: review queues, suggestions, nested lists, schedules, file identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewell.functions.dates import backoff_hours, days_until
from pricewell.functions.semantics import half_up
from pricewell.functions.text import collated, fold, normalize, slug
from pricewell.operators.keyed import neighbours
from pricewell.operators.keyed import unique_slugs as assign_slugs
from pricewell.registry import query
from pricewell.sources.tables import table


@query(
    "validation_queue",
    """SELECT p_partkey, conf FROM (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE (p_partkey % 100) / 100.0::DOUBLE END AS conf FROM part) ORDER BY coalesce(conf, 1), p_partkey LIMIT 50""",
)
def validation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending offers, least sure first; a missing confidence counts as 1."""
    conf = F.when(F.col("p_partkey") % 6 != 0, (F.col("p_partkey") % 100) / F.lit(100.0))
    return table(spark, sf_dir, "part").select("p_partkey", conf.alias("conf")).orderBy(F.coalesce("conf", F.lit(1.0)), "p_partkey").limit(50)


@query(
    "fix_queue",
    """WITH q AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 5 = 0 ORDER BY p_partkey LIMIT 40)
SELECT id, coalesce(lead(id) OVER (ORDER BY id), first_value(id) OVER (ORDER BY id)) AS next, coalesce(lag(id) OVER (ORDER BY id), (SELECT max(id) FROM q)) AS prev FROM q""",
)
def fix_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty products to mend with their neighbours in the queue, which wraps around. The window runs over the forty."""
    q = table(spark, sf_dir, "part").filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("id")).orderBy("id").limit(40)
    return neighbours(q, [F.col("id")], "id")


@query(
    "brand_suggestions",
    r"""WITH o AS (SELECT p_partkey, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(strip_accents(p_name || ' ' || p_type)), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) > 2)) AS t FROM part),
b AS (SELECT DISTINCT p_type AS brand, list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_type), '[^a-z0-9\s]', ' ', 'g')), ' '), lambda x: length(x) > 2)) AS bt FROM part),
s AS (SELECT p_partkey, brand, count(*) AS score FROM (SELECT p_partkey, unnest(t) AS w FROM o) JOIN (SELECT brand, unnest(bt) AS w FROM b) USING (w) GROUP BY ALL)
SELECT p_partkey, brand, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, brand) AS rn FROM s) WHERE rn <= 5""",
)
def brand_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with the brands whose words its name has."""
    p = table(spark, sf_dir, "part")
    return suggest_brands(p, p)


def suggest_brands(offers: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Up to five brands whose words stand in an offer's name: joined on the word, so only brands that share one meet it."""
    words = lambda x: F.array_distinct(F.filter(F.split(normalize(x), " "), lambda t: F.length(t) > 2))
    named = offers.select("p_partkey", F.explode(words(F.concat_ws(" ", "p_name", "p_type"))).alias("w"))
    brands = catalogue.select(F.col("p_type").alias("brand")).distinct().select("brand", F.explode(words(F.col("brand"))).alias("w"))
    s = named.join(brands, "w").groupBy("p_partkey", "brand").agg(F.count(F.lit(1)).cast("int").alias("score"))
    w = Window.partitionBy("p_partkey").orderBy(F.desc("score"), "brand")
    return s.withColumn("_n", F.row_number().over(w)).filter("_n <= 5").drop("_n")


@query(
    "unique_slugs",
    """WITH RECURSIVE s AS (SELECT p_partkey, replace(lower(p_name), ' ', '-') AS root, replace(lower(p_name), ' ', '-') || CASE WHEN p_partkey % 7 = 0 THEN '-' || CAST(p_partkey % 5 + 1 AS STRING) ELSE '' END AS base FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY p_partkey) AS j FROM s),
t AS (SELECT root, 0::BIGINT AS j, 0::BIGINT AS p_partkey, '' AS slug, CASE WHEN min(p_partkey) % 2 = 0 THEN [root, root || '-2'] ELSE [root || '-1'] END AS used FROM s GROUP BY root
  UNION ALL SELECT t.root, r.j, r.p_partkey, x.slug, list_append(t.used, x.slug) FROM t JOIN r ON r.root = t.root AND r.j = t.j + 1,
  LATERAL (SELECT list_filter(list_prepend(r.base, list_transform(range(1, len(t.used) + 2), lambda i: r.base || '-' || i)), lambda f: NOT list_contains(t.used, f))[1] AS slug) x)
SELECT p_partkey, slug FROM t WHERE j > 0""",
)
def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs made unique by the first free number, in order of age, beside names that end in a number themselves and slugs in use."""
    part, own = table(spark, sf_dir, "part"), slug(F.col("p_name"))
    named = part.select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.concat(own, F.lit("-"), (F.col("p_partkey") % 5 + 1).cast("string"))).otherwise(own).alias("base"))
    used = part.groupBy(own.alias("root")).agg(F.min("p_partkey").alias("first")).select(F.explode(F.when(F.col("first") % 2 == 0, F.array("root", F.concat("root", F.lit("-2")))).otherwise(F.array(F.concat("root", F.lit("-1"))))).alias("slug"))
    return assign_slugs(named, "base", ["p_partkey"], used).select("p_partkey", "slug")


@query(
    "network_members",
    """SELECT n_name AS nation, count(s_suppkey) AS stores, coalesce(string_agg(s_name, ',' ORDER BY s_suppkey), '') AS names FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name""",
)
def network_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each network with its stores nested and sorted; networks without stores stay."""
    from pricewell.operators.joins import nest

    child = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", "s_name")
    parent = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nation"))
    kids = nest(parent, child.withColumnRenamed("s_suppkey", "id"), "k", ["id", "s_name"], "stores", ["id"])
    return kids.select("nation", F.size("stores").cast("long").alias("stores"), F.array_join("stores.s_name", ",").alias("names"))


@query(
    "merged_sources",
    """WITH a AS (SELECT o_custkey AS k, o_orderpriority AS title, CAST(NULL AS VARCHAR) AS note, o_orderkey AS id, 0 AS src FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, NULL, o_orderstatus, o_orderkey, 1 FROM orders WHERE o_orderkey % 2 = 1)
SELECT k, arg_min(title, (src, id)) FILTER (WHERE title IS NOT NULL) AS title, arg_min(note, (src, id)) FILTER (WHERE note IS NOT NULL) AS note, count(DISTINCT id) AS pages FROM a GROUP BY k""",
)
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources merged by key: the first known value of each column wins, pages are united."""
    o = table(spark, sf_dir, "orders")
    null = F.lit(None).cast("string")
    a = o.filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("title"), null.alias("note"), F.col("o_orderkey").alias("id"), F.lit(0).alias("src"))
    b = o.filter("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("k"), null.alias("title"), F.col("o_orderstatus").alias("note"), F.col("o_orderkey").alias("id"), F.lit(1).alias("src"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("src", "id"))).alias(c)
    return a.unionByName(b).groupBy("k").agg(first("title"), first("note"), F.count_distinct("id").alias("pages"))


@query(
    "file_identity",
    """SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus, '|' ORDER BY o_orderkey)) AS file_hash, count(*) AS pages FROM orders GROUP BY o_custkey""",
)
def file_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash over a file's pages in order."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("p"))
    parts = F.transform("p", lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"]))
    return o.select("o_custkey", F.sha2(F.array_join(parts, "|"), 256).alias("file_hash"), F.size("p").cast("long").alias("pages"))


@query(
    "schedule",
    """WITH r AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, max(ts) AS last_ts FROM events GROUP BY user_id)
SELECT user_id, CAST(least(errors, 6) AS BIGINT) AS attempts, CASE WHEN errors >= 4 THEN 'error' ELSE 'active' END AS status, CASE WHEN errors > 0 THEN least(8.0::DOUBLE, pow(2.0, least(errors, 6) - 1)) END AS wait_hours,
  CAST(date_diff('hour', date_trunc('hour', last_ts), least(greatest(date_trunc('hour', last_ts) + INTERVAL 2 HOUR, TIMESTAMP '2024-01-30'), TIMESTAMP '2024-01-30' + INTERVAL 6 HOUR)) AS BIGINT) AS hours_to_next FROM r""",
)
def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a worker runs next: backoff after errors, never before now, at most six hours ahead."""
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.date_trunc("hour", F.max("ts").cast("timestamp")).alias("last"))
    now = F.lit("2024-01-30").cast("timestamp")
    after = F.least(F.greatest(F.col("last") + F.expr("INTERVAL 2 HOURS"), now), now + F.expr("INTERVAL 6 HOURS"))
    n = F.least(F.col("errors"), F.lit(6))
    return r.select("user_id", n.cast("long").alias("attempts"), F.when(F.col("errors") >= 4, "error").otherwise("active").alias("status"), F.when(F.col("errors") > 0, backoff_hours(n)).alias("wait_hours"), ((F.unix_timestamp(after) - F.unix_timestamp("last")) / 3600).cast("long").alias("hours_to_next"))


@query(
    "intervals",
    """SELECT user_id, count(*) AS gaps, CAST(floor(avg(g) + 0.5) AS BIGINT) AS mean_gap_s, max(g) AS longest_s FROM (SELECT user_id, date_diff('second', date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), date_trunc('second', ts)) AS g FROM events) WHERE g IS NOT NULL GROUP BY user_id""",
)
def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time between a worker's runs."""
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    g = table(spark, sf_dir, "events").select("user_id", (s - F.lag(s).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("g")).filter("g IS NOT NULL")
    return g.groupBy("user_id").agg(F.count(F.lit(1)).alias("gaps"), F.floor(F.avg("g") + 0.5).cast("long").alias("mean_gap_s"), F.max("g").alias("longest_s"))


@query(
    "expiry_pills",
    """SELECT o_orderkey, CAST(date_diff('day', CAST(TIMESTAMP '2000-06-01 02:00:00' - INTERVAL 5 HOUR AS DATE), CAST(o_orderdate + INTERVAL 7 DAY - INTERVAL 5 HOUR AS DATE)) AS INTEGER) AS days FROM orders""",
)
def expiry_pills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days until a flyer ends, counted in the market's zone."""
    o = table(spark, sf_dir, "orders")
    end = (F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).cast("timestamp")
    return o.select("o_orderkey", days_until(F.lit("2000-06-01 02:00:00").cast("timestamp"), end, "Etc/GMT+5").alias("days"))


@query(
    "region_stores",
    """SELECT s_suppkey, s_name, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lower(strip_accents(r_name)) = 'europe' OR lower(strip_accents(n_name)) = 'europe'""",
)
def region_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores whose region or network's place equals a place, without accents and case."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    same = lambda c: F.lower(fold(F.col(c))) == "europe"
    return s.filter(same("r_name") | same("n_name")).select("s_suppkey", "s_name", F.col("r_name").alias("region"))


@query(
    "nearby_flyers",
    """WITH o AS (SELECT l_orderkey, count(*) AS valid_offers, min(l_extendedprice / l_quantity) AS low FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-05-01' AND l_shipdate <= TIMESTAMP '2000-06-01' GROUP BY 1)
SELECT o_orderkey, valid_offers, CAST(floor(low * 100.0 + 0.5) AS DOUBLE) / 100.0 AS cheapest FROM orders JOIN o ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' ORDER BY valid_offers DESC, o_orderkey LIMIT 30""",
)
def nearby_flyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published flyers with the number of their valid offers, the thirty fullest."""
    li = table(spark, sf_dir, "lineitem").filter("l_shipdate >= TIMESTAMP_NTZ '2000-05-01' AND l_shipdate <= TIMESTAMP_NTZ '2000-06-01'")
    o = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("valid_offers"), F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("low"))
    f = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey")
    return o.join(f, "o_orderkey").orderBy(F.desc("valid_offers"), "o_orderkey").limit(30).select("o_orderkey", "valid_offers", half_up(F.col("low"), 2).alias("cheapest"))


@query(
    "shopping_lists",
    """SELECT conv_id, count(*) AS items, count(DISTINCT role) AS kinds, string_agg(role, ',' ORDER BY turn) AS roles, max(turn) + 1 AS next_order FROM conversations GROUP BY conv_id""",
)
def shopping_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with their items in order and the number the next one gets."""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("role").alias("kinds"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"), (F.max("turn") + 1).alias("next_order"))
    return g.select("conv_id", "items", "kinds", F.array_join("r.role", ",").alias("roles"), "next_order")


_VARIED = "CASE p_partkey % 9 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(replace(p_name, 'e', 'é'), 'o', 'ö') WHEN 2 THEN replace(p_name, ' ', '-') WHEN 3 THEN replace(p_name, ' ', '') WHEN 4 THEN CAST(p_size AS STRING) || ' ' || p_name WHEN 5 THEN '_' || p_name WHEN 6 THEN initcap(p_name) WHEN 7 THEN replace(p_name, 'a', 'ã') ELSE p_name END"


@query(
    "collated_names",
    f"""WITH n AS (SELECT p_partkey, {_VARIED.replace('initcap(p_name)', "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')")} AS name FROM part), r AS (SELECT *, row_number() OVER (ORDER BY icu_sort_key(name, 'pt'), p_partkey) AS place FROM n) SELECT p_partkey, name, CAST(place AS INTEGER) AS place FROM r WHERE place <= 300""",
)
def collated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three hundred names as a Portuguese reader sorts them: letters before accents, accents before case, signs before digits before letters."""
    named = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_VARIED} AS name")
    first = named.orderBy(collated(F.col("name")), "p_partkey").limit(300)
    return first.select("p_partkey", "name", F.row_number().over(Window.orderBy(collated(F.col("name")), "p_partkey")).alias("place"))  # three hundred rows


@query("same_names", f"""WITH n AS (SELECT {_VARIED.replace('initcap(p_name)', "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')")} AS name FROM part) SELECT lower(strip_accents(min(name))) AS name, count(*) AS offers, count(DISTINCT name) AS spellings FROM n GROUP BY lower(strip_accents(name))""")
def same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are one but for accents and case, and in how many spellings they stand."""
    named = table(spark, sf_dir, "part").selectExpr(f"{_VARIED} AS name")
    g = named.groupBy(F.collate("name", "pt_CI_AI").alias("k")).agg(F.count(F.lit(1)).alias("offers"), F.count_distinct("name").alias("spellings"), F.min("name").alias("name"))
    return g.select(fold(F.lower("name")).alias("name"), "offers", "spellings")


@query(
    "delete_cascade",
    """WITH g AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01') SELECT 'orders' AS name, count(*) AS kept FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM g) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM g)""",
)
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left in parent and child after a deletion that reaches the children."""
    from pricewell.sources.sinks import cascade, delete

    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey")
    gone = o.filter("o_orderstatus = 'F' AND o_orderdate < TIMESTAMP_NTZ '1996-01-01'").select("o_orderkey")
    left = delete(o.select("o_orderkey"), gone, ["o_orderkey"])
    kids = cascade(gone, "o_orderkey", {"lineitem": (li, "l_orderkey")})["lineitem"]
    counted = lambda df, name: df.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(name).alias("name"), "kept")
    return counted(left, "orders").unionByName(counted(kids, "lineitem"))


@query(
    "upsert_rows",
    """WITH n AS (SELECT c_custkey + 700 AS k, c_acctbal * 0 AS v FROM customer), o AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer) SELECT k, v FROM n UNION ALL SELECT k, v FROM o WHERE k NOT IN (SELECT k FROM n)""",
)
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows replace old ones of the same key; the rest stays."""
    from pricewell.sources.sinks import upsert

    c = table(spark, sf_dir, "customer")
    return upsert(c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), c.select((F.col("c_custkey") + 700).alias("k"), (F.col("c_acctbal") * 0).alias("v")), ["k"])
