"""Writes and plain reads: inserts, patches, toggles, children, defaults, favourites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewell.functions.text import slug
from pricewell.operators.filters import flyer_current
from pricewell.operators.joins import lookup, nest
from pricewell.operators.listing import contains_text
from pricewell.plans.frames import cte, day, frame, norm
from pricewell.registry import query
from pricewell.sources import sinks
from pricewell.sources.scratch import new_folder
from pricewell.sources.tables import table

NOW = "2000-06-01"


@query("appended_rows", "SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey + 100, upper(n_name) FROM nation")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written in two appends and read again."""
    n, path = table(spark, sf_dir, "nation"), new_folder(spark)
    sinks.append(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), path)
    sinks.append(n.select((F.col("n_nationkey") + 100).alias("k"), F.upper("n_name").alias("v")), path)
    return spark.read.parquet(path)


@query("swapped_table", "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE n_name END AS v FROM nation")
def swapped_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced by its patched version: readers see the old or the new one."""
    n, path = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), new_folder(spark)
    sinks.swap(spark, n, path)
    old = spark.read.parquet(sinks.current(spark, path))
    sinks.swap(spark, sinks.patch(old, n.filter("k % 2 = 0").select("k", F.lit("new").alias("v")), ["k"], ["v"]), path)
    return spark.read.parquet(sinks.current(spark, path))


@query("market_layout", f"WITH {cte('offers')} SELECT id, supermarket_id, CASE WHEN supermarket_id IN (2, 3) THEN 'pending' ELSE validation_status END AS validation_status FROM offers WHERE supermarket_id IN (1, 2) UNION ALL SELECT 'new', 2, 'pending'")
def market_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers laid out by market; two markets' folders are replaced, and one of these and another are read."""
    o, path = frame(spark, sf_dir, "offers").select("id", "supermarket_id", "validation_status"), new_folder(spark)
    sinks.lay_out(o, path, ["supermarket_id"])
    new = o.filter(F.col("supermarket_id").isin(2, 3)).withColumn("validation_status", F.lit("pending"))
    sinks.replace_parts(new.unionByName(spark.range(1).select(F.lit("new").alias("id"), F.lit(2).cast("long").alias("supermarket_id"), F.lit("pending").alias("validation_status"))), path, ["supermarket_id"])
    return spark.read.schema(o.schema).parquet(path).filter(F.col("supermarket_id").isin(1, 2))


@query("wiped_tables", "SELECT 'a' AS name, 0::BIGINT AS n UNION ALL SELECT 'b', 0::BIGINT")
def wiped_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that were emptied."""
    base, n = new_folder(spark), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    tables = {name: (f"{base}/{name}", "k int") for name in ("a", "b")}
    for path, _ in tables.values():
        sinks.swap(spark, n, path)
    sinks.wipe(spark, tables)
    counted = [spark.read.parquet(sinks.current(spark, path)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, (path, _) in tables.items()]
    return counted[0].unionByName(counted[1])


@query("patched_rows", "SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'x' ELSE c_mktsegment END AS v, c_acctbal AS w FROM customer")
def patched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named columns of some rows changed; null clears."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), F.col("c_acctbal").alias("w"))
    return sinks.patch(c, c.filter("k % 4 < 2").select("k", F.when(F.col("k") % 4 == 1, "x").alias("v")), ["k"], ["v"])


@query("absent_rows", "SELECT c_custkey AS k, 'old' AS v FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0")
def absent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that were not there come in, none is replaced."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return sinks.insert_absent(c.filter("k % 3 > 0").withColumn("v", F.lit("old")), c.withColumn("v", F.lit("new")), ["k"])


@query("toggled_rows", "SELECT c_custkey AS k FROM customer WHERE (c_custkey % 2 = 0) <> (c_custkey % 3 = 0)")
def toggled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourites that are there go, others come."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return sinks.toggle(c.filter("k % 2 = 0"), c.filter("k % 3 = 0"))


@query("replaced_scope", f"WITH {cte('offers')} SELECT id, validation_status FROM offers WHERE NOT (flyer_id = '3' AND coalesce(page_number IN (1, 2), false) AND validation_status IN ('pending', 'rejected')) UNION ALL SELECT 'new-' || id, 'pending' FROM offers WHERE flyer_id = '3' AND page_number = 1")
def replaced_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flyer's offers of some pages and states make way for a new reading; locked ones stay. Without a scope nothing comes twice."""
    o = frame(spark, sf_dir, "offers").select("id", "flyer_id", "page_number", "validation_status")
    key = F.col("flyer_id") == "3"
    new = o.filter(key & (F.col("page_number") == 1)).withColumns({"id": F.concat(F.lit("new-"), "id"), "validation_status": F.lit("pending")})
    scope = F.coalesce(F.col("page_number").isin(1, 2), F.lit(False)) & F.col("validation_status").isin("pending", "rejected")
    done = sinks.replace_scope(o, new, scope, key)
    return sinks.replace_scope(done, new, None, key).select("id", "validation_status")


@query("canonical_list", f"SELECT p_partkey, p_name FROM part WHERE p_partkey % 5 > 0 AND contains({norm('p_name')}, 'blue') ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def canonical_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by a search, the fifty newest."""
    p = contains_text(table(spark, sf_dir, "part").filter("p_partkey % 5 > 0"), " Blúe", "p_name")
    return p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(50).select("p_partkey", "p_name")


@query("pending_downloads", f"WITH {cte('flyers')} SELECT id, coalesce(s_name, '—') AS market FROM flyers LEFT JOIN supplier ON s_suppkey = supermarket_id WHERE status = 'discovered'")
def pending_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supermarket_id"), F.col("s_name").alias("market"))
    return lookup(frame(spark, sf_dir, "flyers").filter("status = 'discovered'"), names, "supermarket_id", "market").select("id", "market")


@query("default_stores", f"SELECT s_suppkey AS market, s_name || ' — ' || n_name AS name, replace({norm(chr(39) + chr(39) + ' || s_name || ' + chr(39) + ' — ' + chr(39) + ' || n_name')}, ' ', '-') AS slug, upper(r_name) AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 0 AND s_suppkey % 3 <> 0")
def default_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One store for each active market that has none."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = s.filter("s_acctbal > 0").withColumn("market", F.col("s_suppkey"))
    have = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("market"))
    name = F.concat("s_name", F.lit(" — "), "n_name")
    return s.join(have, "market", "left_anti").select("market", name.alias("name"), slug(name, 60, "loja").alias("slug"), F.upper(F.trim("r_name")).alias("state"))


@query("filled_validity", f"WITH {cte('flyers')} SELECT id, {day('coalesce(valid_from, created_at)')} AS valid_from, {day('coalesce(valid_until, updated_at)')} AS valid_until FROM flyers")
def filled_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds that are missing are filled, others stay."""
    f = frame(spark, sf_dir, "flyers").withColumns({"valid_from": F.coalesce("valid_from", "created_at"), "valid_until": F.coalesce("valid_until", "updated_at")})
    return f.select("id", *[F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) for c in ("valid_from", "valid_until")])


@query("run_progress", f"WITH {cte('runs')} SELECT id, CASE WHEN status = 'running' THEN 7 ELSE 0 END AS steps, CASE WHEN id % 13 = 0 THEN 'success' ELSE status END AS status FROM runs")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress reaches only runs that go on; a finished one gets its state whatever it was."""
    r = frame(spark, sf_dir, "runs").withColumn("steps", F.lit(0))
    going = r.filter("status = 'running'").select("id", F.lit(7).alias("steps"))
    r = sinks.patch(r, going, ["id"], ["steps"])
    return sinks.patch(r, r.filter("id % 13 = 0").select("id", F.lit("success").alias("status")), ["id"], ["status"]).select("id", "steps", "status")


@query("discarded_pages", """WITH p AS (SELECT l_orderkey AS f, l_linenumber AS page FROM lineitem GROUP BY ALL), n AS (SELECT f, count(*) AS c FROM p GROUP BY 1) SELECT p.f, page FROM p JOIN n ON n.f = p.f WHERE NOT (p.f % 2 = 0 AND (c <= 1 OR page = 1))""")
def discarded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 1 of some flyers goes; a flyer's last page takes the flyer along."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("f"), F.col("l_linenumber").alias("page")).distinct()
    n = p.groupBy("f").agg(F.count(F.lit(1)).alias("c"))
    gone = p.join(n, "f").filter((F.col("f") % 2 == 0) & ((F.col("c") <= 1) | (F.col("page") == 1))).select("f", "page")
    return sinks.delete(p, gone, ["f", "page"])


@query("replaced_children", f"""WITH {cte('flows')}, s AS (SELECT conv_id AS flow, turn AS ord, role AS kind FROM conversations), x AS (SELECT DISTINCT flow FROM s WHERE flow % 2 = 0) SELECT 'step' AS what, flow, ord, kind FROM s WHERE flow % 2 <> 0 UNION ALL SELECT 'step', flow, 0, 'navigate' FROM x UNION ALL SELECT 'flow', f.id, f.version + CASE WHEN x.flow IS NULL THEN 0 ELSE 1 END, CASE WHEN x.flow IS NOT NULL AND status = 'active' THEN 'testing' ELSE status END FROM flows f LEFT JOIN x ON x.flow = f.id UNION ALL SELECT 'event', flow, 0, 'save' FROM x""")
def replaced_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of some flows replaced: the version grows, an active flow is tested again, and an event tells."""
    c = F.col
    s = table(spark, sf_dir, "conversations").select(c("conv_id").alias("flow"), c("turn").alias("ord"), c("role").alias("kind"))
    x = s.filter("flow % 2 = 0").select("flow").distinct()
    new = x.select("flow", F.lit(0).cast("long").alias("ord"), F.lit("navigate").alias("kind"))
    steps = sinks.delete(s, x, ["flow"]).unionByName(new)
    flows = frame(spark, sf_dir, "flows").join(x.select(c("flow").alias("id"), F.lit(True).alias("hit")), "id", "left")
    flows = flows.select(c("id").alias("flow"), (c("version") + F.when(c("hit"), 1).otherwise(0)).alias("ord"), F.when(c("hit") & (c("status") == "active"), "testing").otherwise(c("status")).alias("kind"))
    events = x.select("flow", F.lit(0).cast("long").alias("ord"), F.lit("save").alias("kind"))
    told = lambda df, what: df.select(F.lit(what).alias("what"), "flow", "ord", "kind")
    return told(steps, "step").unionByName(told(flows, "flow")).unionByName(told(events, "event"))


@query("source_stores", """WITH b AS (SELECT s_nationkey AS source, s_suppkey AS store FROM supplier) SELECT n_nationkey AS source, CASE WHEN n_nationkey % 2 = 0 THEN 'store' ELSE 'network' END AS scope, CASE WHEN n_nationkey % 2 = 0 THEN coalesce((SELECT string_agg(CAST(store AS STRING), ',' ORDER BY store) FROM b WHERE b.source = n_nationkey), '') ELSE '' END AS stores FROM nation""")
def source_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with the stores of their bridge, only where their scope is a store."""
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("source"), F.col("s_suppkey").alias("store"))
    s = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source"), F.when(F.col("n_nationkey") % 2 == 0, "store").otherwise("network").alias("scope"))
    kids = nest(s, b.join(s.filter("scope = 'store'"), "source", "left_semi"), "source", ["store"], "stores", ["store"])
    return kids.select("source", "scope", F.array_join(F.transform("stores", lambda x: x["store"].cast("string")), ",").alias("stores"))


@query("owned_lists", "SELECT conv_id AS list, count(*) AS items FROM conversations WHERE conv_id % 3 = 1 GROUP BY conv_id")
def owned_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's lists with the number of their items; other users' lists are not there."""
    return table(spark, sf_dir, "conversations").filter("conv_id % 3 = 1").groupBy(F.col("conv_id").alias("list")).agg(F.count(F.lit(1)).alias("items"))


@query("favourite_products", "SELECT c_custkey AS favourite, p_partkey AS product, p_name AS name, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS brand FROM customer JOIN part ON p_partkey = c_custkey * 3")
def favourite_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourites with product and brand; of a product that is gone nothing is told."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand")).alias("brand"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("favourite"), (F.col("c_custkey") * 3).alias("product")).join(p, "product").select("favourite", "product", "name", "brand")


@query("inserted_rows", f"WITH {cte('flows')} SELECT id, coalesce(nullif(CASE WHEN id % 4 = 0 THEN '' ELSE start_url END, ''), 'https://market.example/' || CAST(supermarket_id AS STRING)) AS url, coalesce(CASE WHEN id % 3 = 0 THEN 2.0::DOUBLE END, 1.0::DOUBLE) AS quantity, 'draft' AS status, (row_number() OVER (PARTITION BY supermarket_id ORDER BY id) - 1)::BIGINT AS ord FROM flows")
def inserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows with their defaults: an address that falls back on the market's, a quantity of one, the next number of their parent."""
    f, c = frame(spark, sf_dir, "flows"), F.col
    given = F.when(c("id") % 4 == 0, "").otherwise(c("start_url"))
    number = F.row_number().over(Window.partitionBy("supermarket_id").orderBy("id")) - 1
    return f.select("id", F.coalesce(F.nullif(given, F.lit("")), F.concat(F.lit("https://market.example/"), c("supermarket_id").cast("string"))).alias("url"), F.coalesce(F.when(c("id") % 3 == 0, 2.0), F.lit(1.0)).alias("quantity"), F.lit("draft").alias("status"), number.cast("long").alias("ord"))


@query("enriched_offer", f"WITH {cte('offers')} SELECT id, name, coalesce(s_name, '—') AS market, 'F' || flyer_id AS flyer FROM offers LEFT JOIN supplier ON s_suppkey = supermarket_id WHERE id = '6' AND validation_status = 'validated'")
def enriched_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One offer with its market and flyer, only if it is validated."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supermarket_id"), F.col("s_name").alias("market"))
    o = frame(spark, sf_dir, "offers").filter("id = '6' AND validation_status = 'validated'")
    return lookup(o, names, "supermarket_id", "market").select("id", "name", "market", F.concat(F.lit("F"), "flyer_id").alias("flyer"))


@query("scoped_offers", f"""WITH {cte('flyers')}, f AS (SELECT id, n, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 5 = 1 THEN CAST([] AS BIGINT[]) ELSE [n % 10, n % 7] END AS stores FROM flyers WHERE status NOT IN ('expired', 'failed') AND (valid_from IS NULL OR valid_from <= TIMESTAMP '{NOW}') AND (valid_until IS NULL OR valid_until >= TIMESTAMP '{NOW}')), s AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN f ON n = l_orderkey WHERE coalesce(len(stores), 0) = 0 OR n IN (SELECT n FROM (SELECT n, unnest(stores) AS k FROM f) WHERE k IN (SELECT k FROM s))""")
def scoped_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of live flyers that apply to some of the chosen stores; the stores are a small dimension, joined by their number."""
    n, c = F.col("n"), F.col
    f = frame(spark, sf_dir, "flyers").filter(flyer_current(c("status"), c("valid_from"), c("valid_until"), F.lit(NOW).cast("timestamp_ntz")))
    f = f.select("n", F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, F.array().cast("array<bigint>")).otherwise(F.array(n % 10, n % 7)).alias("stores"))
    chosen = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(c("s_suppkey").alias("store"))
    everywhere = f.filter(F.coalesce(F.size("stores"), F.lit(0)) <= 0).select("n")
    some = f.select("n", F.explode("stores").alias("store")).join(chosen, "store", "left_semi").select("n").distinct()
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.join(everywhere.unionByName(some).withColumnRenamed("n", "l_orderkey"), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
