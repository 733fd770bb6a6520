"""Text scalars, parsing and entity resolution over documents, parts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewell.functions import money, parse
from pricewell.functions.semantics import half_up, ranking_price, ratio_pct, valid_at
from pricewell.functions.text import dedupe_key, fold, group_key, match_key, name_divergence, normalize, sanitize_name, slug, title_case, tokens_match
from pricewell.operators.filters import lacks_brand, lacks_quantity, lacks_unit, offer_valid, validation_status
from pricewell.operators.resolve import normalize_offers
from pricewell.plans.frames import cte, frame, half, number, unit
from pricewell.plans.rule_plans import PRICE_RE, RANKED_SQL, payment_sql, phrases_sql, shape_sql
from pricewell.registry import query
from pricewell.sources.tables import PRICES_SQL, prices, table

_NORM = r"trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("normalize_text", rf"SELECT doc_id, md5({_NORM.format('text')}) AS normalized_md5, length({_NORM.format('text')}) AS chars FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").select("doc_id", normalize(F.col("text")).alias("n"))
    return n.select("doc_id", F.md5("n").alias("normalized_md5"), F.length("n").cast("long").alias("chars"))


@query(
    "match_key",
    rf"""SELECT p_partkey, concat_ws('|', {_NORM.format('p_name')}, {_NORM.format('p_brand')}, CAST(p_size AS STRING), CASE p_size % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'l' WHEN 2 THEN 'un' END) AS match_key,
regexp_replace({_NORM.format('p_name')}, '\s+', '-', 'g') AS slug, replace({_NORM.format('p_brand')}, ' ', '-') AS brand_slug FROM part""",
)
def match_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("p_size") % 4 == 0, "Kilos").when(F.col("p_size") % 4 == 1, "Lt.").when(F.col("p_size") % 4 == 2, "unid").otherwise("dozen")
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", match_key(F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string"), unit).alias("match_key"), slug(F.col("p_name")).alias("slug"), slug(F.col("p_brand"), 60, "market").alias("brand_slug"))


@query(
    "url_keys",
    r"""SELECT page_id, CASE WHEN regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\.(jpe?g|png|webp)$') THEN 'page_image'
  WHEN regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\.(mp4|mp3|gif|svg|css|js|woff2?)$') THEN 'media' WHEN regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '(privacidade|privacy|termos|terms|cookies?|politica|policy)') THEN 'policy' ELSE 'page' END AS kind,
  CASE WHEN regexp_extract(url, '[?&]id=([^&#]+)', 1) <> '' THEN 'id:' || regexp_extract(url, '[?&]id=([^&#]+)', 1) ELSE regexp_replace(url, '#.*$', '') || regexp_extract(url, '(#item-\d+)$', 1) END AS url_key FROM pages""",
)
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", parse.url_kind(F.col("url")).alias("kind"), parse.url_key(F.col("url")).alias("url_key"))


_OFFER_TEXT = "concat('Arroz ', p_name, ' ', CAST(p_size AS STRING), ' kg DE R$ ', CAST(p_partkey % 90 + 10 AS STRING), ',90 POR ', CAST(p_partkey % 9 + 1 AS STRING), ',49 ', CASE WHEN p_partkey % 3 = 0 THEN 'ou 10x de R$ 1,99 sem juros' WHEN p_partkey % 3 = 1 THEN 'à vista exclusivo no app' ELSE 'no cartão da loja' END)"


@query(
    "price_extract",
    rf"""WITH t AS (SELECT p_partkey, {_OFFER_TEXT} AS t FROM part), x AS (SELECT p_partkey, list_transform(regexp_extract_all(t, '(\d{{1,3}}(?:\.\d{{3}})*,\d{{2}}|\d+,\d{{2}})', 1), lambda s: CAST(replace(replace(s, '.', ''), ',', '.') AS DOUBLE)) AS ps FROM t)
SELECT p_partkey, CAST(len(ps) AS BIGINT) AS prices, list_min(ps) AS low, list_max(ps) AS high FROM x""",
)
def price_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part").select("p_partkey", money.extract_prices(F.expr(_OFFER_TEXT)).alias("ps"))
    return x.select("p_partkey", F.size("ps").cast("long").alias("prices"), F.array_min("ps").alias("low"), F.array_max("ps").alias("high"))


@query(
    "auto_validate",
    f"""WITH {PRICES_SQL}, o AS (SELECT product, market, price, p_name, (p_partkey % 100) / 100.0::DOUBLE AS conf FROM prices JOIN part ON product = p_partkey),
v AS (SELECT *, CASE WHEN length(p_name) < 4 OR price <= 0 THEN 'rejected' WHEN coalesce(conf, 0.7) < 0.5 THEN 'rejected' WHEN coalesce(conf, 0.7) >= 0.8 AND price BETWEEN 0.1 AND 5000 THEN 'validated' WHEN price NOT BETWEEN 0.1 AND 5000 THEN 'suspicious' ELSE 'validated' END AS status FROM o)
SELECT market, count(*) FILTER (WHERE status = 'validated') AS validated, count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status = 'suspicious') AS suspicious FROM v GROUP BY market""",
)
def auto_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule verdicts of offers, counted by market; names come from the product dimension."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), "p_name")
    o = prices(spark, sf_dir).select("product", "market", "price").join(names, "product")
    v = o.withColumn("s", validation_status(F.col("p_name"), F.col("price"), (F.col("product") % 100) / F.lit(100.0)))
    return v.groupBy("market").agg(*[F.count_if(F.col("s") == x).alias(x) for x in ("validated", "rejected", "suspicious")])


@query(
    "divergent_names",
    rf"""WITH o AS (SELECT p_partkey % 200 AS product, {_NORM.format('p_name')} AS n FROM part),
c AS (SELECT product, min(n) AS canonical FROM o GROUP BY 1),
d AS (SELECT o.product, n, canonical, string_split(canonical, ' ') AS a, string_split(n, ' ') AS b FROM o JOIN c USING (product))
SELECT product, count(DISTINCT n) AS names, count(DISTINCT n) FILTER (WHERE len(list_filter(b, lambda x: list_contains(a, x))) / greatest(len(a), len(b))::DOUBLE < 0.35) AS divergent FROM d GROUP BY product""",
)
def divergent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose offers' names share few words with the canonical name."""
    o = table(spark, sf_dir, "part").select((F.col("p_partkey") % 200).alias("product"), normalize(F.col("p_name")).alias("n"))
    d = o.join(o.groupBy("product").agg(F.min("n").alias("canonical")), "product")
    return d.groupBy("product").agg(F.count_distinct("n").alias("names"), F.count_distinct(F.when(name_divergence(F.col("canonical"), F.col("n")), F.col("n"))).alias("divergent"))


@query(
    "brand_counts",
    """SELECT p_brand AS brand, count(DISTINCT p_partkey) AS products, count(l_orderkey) AS offers, row_number() OVER (ORDER BY count(l_orderkey) DESC, p_brand) AS rank FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand""",
)
def brand_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products and offers of each brand; offers are counted per product before they meet brands."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(li, "p_partkey", "left").groupBy(F.col("p_brand").alias("brand")).agg(F.count_distinct("p_partkey").alias("products"), F.coalesce(F.sum("n"), F.lit(0)).alias("offers"))
    return b.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("offers"), "brand")).cast("long"))


@query(
    "title_names",
    r"""SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, lower(strip_accents(regexp_replace(trim(p_name), '[ \t]+', ' ', 'g'))) AS dedupe_key, length(p_name) AS chars FROM part""",
)
def title_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", title_case(n).alias("title"), dedupe_key(n).alias("dedupe_key"), F.length(sanitize_name(n)).cast("long").alias("chars"))


@query("folded_lengths", "SELECT lang, count(*) AS docs, CAST(sum(length(strip_accents(text))) AS BIGINT) AS chars, count(*) FILTER (WHERE strip_accents(text) <> text) AS accented FROM documents GROUP BY lang")
def folded_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "text", fold(F.col("text")).alias("f"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("f")).alias("chars"), F.count_if(F.col("f") != F.col("text")).alias("accented"))


_DOUBTS = """o AS (SELECT *, CASE WHEN quantity <> '' THEN """ + number("quantity") + """ END AS qv, """ + unit("unit") + """ AS nu, CASE WHEN n % 2 = 0 THEN 'b' END AS brand_id FROM offers),
k AS (SELECT canonical_product_id AS id, count(DISTINCT supermarket_id) AS markets FROM o WHERE canonical_product_id IS NOT NULL GROUP BY 1),
c AS (SELECT canonical_product_id AS id, min(normalized_name) AS cname FROM o WHERE canonical_product_id IS NOT NULL GROUP BY 1), s AS (SELECT DISTINCT canonical_product_id AS id, name FROM o WHERE canonical_product_id IS NOT NULL),
d AS (SELECT id, cname, count(*) AS names, count(*) FILTER (WHERE len(list_filter(string_split(""" + _NORM.format("name") + """, ' '), lambda x: list_contains(string_split(""" + _NORM.format("cname") + """, ' '), x))) / greatest(len(string_split(""" + _NORM.format("name") + """, ' ')), len(string_split(""" + _NORM.format("cname") + """, ' ')))::DOUBLE < 0.35) AS apart, string_agg(name, '|' ORDER BY name) AS sample FROM s JOIN c USING (id) GROUP BY ALL),
l AS (SELECT canonical_product_id AS id, supermarket_id, arg_max(price, (created_at, n)) AS price FROM o WHERE canonical_product_id IS NOT NULL AND (valid_from IS NULL OR valid_from <= TIMESTAMP '2001-06-15') AND (valid_until IS NULL OR valid_until >= TIMESTAMP '2001-06-15') GROUP BY ALL),
x AS (SELECT id, count(*) AS markets, CASE WHEN min(price) > 0 THEN (max(price) - min(price)) / min(price) * 100 ELSE 0 END AS spread FROM l GROUP BY id HAVING count(*) >= 2)"""


def _doubts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Offers, their products' markets, divergent names and spreads of live prices."""
    c = F.col
    o = normalize_offers(frame(spark, sf_dir, "offers"), members=False).withColumn("brand_id", F.when(c("n") % 2 == 0, "b"))
    own = o.filter("canonical_product_id IS NOT NULL").withColumn("id", c("canonical_product_id"))
    k = own.groupBy("id").agg(F.count_distinct("supermarket_id").alias("markets"))
    names = own.select("id", "name").distinct().join(own.groupBy("id").agg(F.min(F.lower("name")).alias("cname")), "id")
    d = names.groupBy("id", "cname").agg(F.count(F.lit(1)).alias("names"), F.count_if(name_divergence(c("cname"), c("name"))).alias("apart"), F.array_join(F.array_sort(F.collect_list("name")), "|").alias("sample"))
    live = own.filter(valid_at(F.lit("2001-06-15").cast("timestamp_ntz"), c("valid_from"), c("valid_until")))
    latest = live.groupBy("id", "supermarket_id").agg(F.max_by("price", F.struct("created_at", "n")).alias("price"))
    x = latest.groupBy("id").agg(F.count(F.lit(1)).alias("markets"), F.min("price").alias("lo"), F.max("price").alias("hi")).filter("markets >= 2")
    return o, k, d.withColumn("divergent", (c("apart") >= 2) | ((c("names") >= 3) & (c("apart") >= 1))), x.withColumn("spread", F.when(c("lo") > 0, (c("hi") - c("lo")) / c("lo") * 100).otherwise(0.0))


@query("health_kpis", f"""WITH {cte('offers')}, {_DOUBTS} SELECT (SELECT count(*) FROM o) AS offers, (SELECT count(*) FROM k) AS products, (SELECT {half("count(brand_id) / greatest(count(*), 1)::DOUBLE * 100", 1)} FROM o) AS brand_pct, (SELECT {half("count(canonical_product_id) / greatest(count(*), 1)::DOUBLE * 100", 1)} FROM o) AS canonical_pct,
  (SELECT count(*) FROM k WHERE markets = 1) AS single_market, (SELECT count(*) FROM d WHERE apart >= 2 OR (names >= 3 AND apart >= 1)) AS divergent, (SELECT count(*) FROM x WHERE spread > 40) AS extreme_spread, (SELECT count(*) FROM o WHERE brand_id IS NULL AND coalesce(brand, '') = '') AS without_brand, (SELECT count(*) FROM o WHERE coalesce(quantity, '') = '' AND coalesce(qv, 0) = 0) AS without_quantity, (SELECT count(*) FROM o WHERE unit <> '' AND nu IS NULL AND coalesce(qv, 0) = 0) AS invalid_unit""")
def health_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten indicators of the catalogue's health; each part is one row."""
    c = F.col
    o, k, d, x = _doubts(spark, sf_dir)
    n = lambda cond, name: F.count_if(cond).alias(name)
    a = o.agg(F.count(F.lit(1)).alias("offers"), F.count("brand_id").alias("b"), F.count("canonical_product_id").alias("p"), n(lacks_brand(c("brand_id"), c("brand")), "without_brand"), n(lacks_quantity(c("quantity"), c("quantity_value")), "without_quantity"), n(lacks_unit(c("unit"), c("unit_normalized"), c("quantity_value")), "invalid_unit"))
    parts = [k.agg(F.count(F.lit(1)).alias("products"), n(c("markets") == 1, "single_market")), d.agg(n(c("divergent"), "divergent")), x.agg(n(c("spread") > 40, "extreme_spread"))]
    for p in parts:
        a = a.crossJoin(F.broadcast(p))
    return a.select("offers", "products", ratio_pct(c("b"), c("offers")).alias("brand_pct"), ratio_pct(c("p"), c("offers")).alias("canonical_pct"), "single_market", "divergent", "extreme_spread", "without_brand", "without_quantity", "invalid_unit")


@query("health_queues", f"""WITH {cte('offers')}, {_DOUBTS}, q AS (SELECT 'single' AS queue, id, 'x' AS told, CAST(0 AS DOUBLE) AS rank FROM k WHERE markets = 1 UNION ALL SELECT 'divergent', id, sample, -least(names, 5) FROM d WHERE apart >= 2 OR (names >= 3 AND apart >= 1) UNION ALL SELECT 'spread', id, CAST(markets AS STRING), -{half('spread', 1)} FROM x WHERE spread > 40)
SELECT queue, id, told FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY rank, id) AS r FROM q) WHERE r <= 40""")
def health_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty products of each doubt: in one market only, of names that differ, of prices that differ."""
    c = F.col
    _, k, d, x = _doubts(spark, sf_dir)
    told = lambda df, name, text, rank: df.select(F.lit(name).alias("queue"), "id", text.alias("told"), rank.cast("double").alias("rank")).orderBy("rank", "id").limit(40)
    single = told(k.filter("markets = 1"), "single", F.lit("x"), F.lit(0))
    apart = told(d.filter("divergent"), "divergent", c("sample"), -F.least(c("names"), F.lit(5)))
    spread = told(x.filter("spread > 40"), "spread", c("markets").cast("string"), -half_up(c("spread"), 1))
    return single.unionByName(apart).unionByName(spread).drop("rank")


_SEARCHED = f"""m AS (SELECT *, coalesce('c:' || canonical_product_id, 't:' || normalized_name || ':' || coalesce(brand, '') || ':' || coalesce(quantity, '')) AS grp, CASE WHEN eligibility IS NOT NULL AND eligibility <> 'ALL_CUSTOMERS' AND original_price IS NOT NULL THEN original_price ELSE price END AS rank_price FROM offers
  WHERE validation_status = 'validated' AND (valid_from IS NULL OR valid_from <= TIMESTAMP '2001-06-15') AND (valid_until IS NULL OR valid_until >= TIMESTAMP '2001-06-15') AND (contains({_NORM.format('name')}, 'bol') OR contains({_NORM.format("coalesce(brand, '')")}, 'bol') OR contains({_NORM.format('normalized_name')}, 'bol')))"""


@query("search_groups", f"""WITH {cte('offers')}, {_SEARCHED} SELECT grp, count(*) AS offers, string_agg(id || ':' || CAST(CAST(floor(rank_price * 100 + 0.5) AS BIGINT) AS STRING), ',' ORDER BY rank_price, id) AS prices, min(rank_price) AS cheapest FROM m GROUP BY grp ORDER BY cheapest, grp LIMIT 40""")
def search_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over four names: groups of offers of one product with their prices in order, the forty cheapest; words of one letter find nothing."""
    return _search(spark, sf_dir, " bol ")


@query("search_short", f"""WITH {cte('offers')}, {_SEARCHED.replace("'bol'", "'bo'")} SELECT 'bo' AS query, count(*) AS found FROM (SELECT grp FROM m GROUP BY grp LIMIT 40) UNION ALL SELECT 'b', 0""")
def search_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much queries of two letters and of one find: the latter nothing."""
    counted = [_search(spark, sf_dir, q).agg(F.count(F.lit(1)).alias("found")).select(F.lit(q).alias("query"), "found") for q in ("bo", "b")]
    return counted[0].unionByName(counted[1])


def _search(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    c, q = F.col, F.lit(text.strip())
    o = frame(spark, sf_dir, "offers").filter(offer_valid(c("validation_status"), c("valid_from"), c("valid_until"), F.lit("2001-06-15").cast("timestamp_ntz")))
    hit = F.lit(False)
    for name in ("name", "brand", "normalized_name"):
        hit = hit | tokens_match(c(name), q)
    o = o.filter(hit & F.lit(len(text.strip()) >= 2))
    club = c("eligibility").isNotNull() & (c("eligibility") != "ALL_CUSTOMERS")
    o = o.select("id", group_key(c("canonical_product_id"), c("normalized_name"), c("brand"), c("quantity")).alias("grp"), ranking_price(c("price"), c("original_price"), club).alias("p"))
    g = o.groupBy("grp").agg(F.count(F.lit(1)).alias("offers"), F.array_sort(F.collect_list(F.struct("p", "id"))).alias("r"), F.min("p").alias("cheapest"))
    line = F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["id"], F.floor(x["p"] * 100 + 0.5).cast("long").cast("string"))), ",")
    return g.select("grp", "offers", line.alias("prices"), "cheapest").orderBy("cheapest", "grp").limit(40)


_ANSWER = """CASE event_id % 5 WHEN 0 THEN '{"offers":[' || one || ',]}' WHEN 1 THEN '```json' || chr(10) || '{"offers":[' || one || ']}' || chr(10) || '```' WHEN 2 THEN '{"offers":[' || one || ',{"name":"cut off","pri' WHEN 3 THEN '{"validFrom":"2024-01-01","confidence":0.94,"offers":[' || one || ',' || one || ',{"name":"12","price":3},{"name":"Gone,}","price":"x"}]}' ELSE '{"offers":[{"name":"TV ' || event_type || '","price":"199,90","installmentCount":12,"installmentAmount":199.9,"installmentInterestFree":"Sem juros","eligibility":"APP_ONLY","conditions":[{"type":"STORE_CARD","name":" Cartao "},{"type":"APP_ONLY"}],"evidence":{"text":"so no app"}}]}' END"""
_JSON_SQL = """j AS (SELECT event_id, event_type, value, event_id % 5 AS kind, CASE WHEN event_id % 5 = 4 THEN 'TV ' || event_type ELSE event_type END AS name FROM events)"""


@query("lenient_json", f"""WITH {_JSON_SQL} SELECT event_id AS page_id, name, CASE WHEN kind < 4 THEN 'kg' END AS unit, CASE WHEN kind = 4 THEN 2398.8::DOUBLE ELSE value END AS price, CASE WHEN kind = 4 THEN 12 END AS installment_count, CASE WHEN kind = 4 THEN true END AS interest_free, 0.7::DOUBLE AS confidence, CASE WHEN kind = 4 THEN 'APP_ONLY' ELSE 'ALL_CUSTOMERS' END AS eligibility, CASE WHEN kind = 4 THEN 'APP_ONLY::so no app,STORE_CARD:Cartao:' ELSE '' END AS conditions,
  CASE WHEN kind = 4 THEN 0.92::DOUBLE ELSE 0.91::DOUBLE END AS eligibility_confidence, CASE WHEN kind = 4 THEN 'so no app/rules/1' END AS evidence, CASE WHEN kind = 3 THEN '2024-01-01' END AS valid_from, CASE WHEN kind = 3 THEN 0.94::DOUBLE END AS page_confidence,
  CASE WHEN kind = 4 THEN '{{"name":"' || name || '","price":2398.8,"installmentCount":12,"installmentAmount":199.9,"eligibility":"APP_ONLY","evidence":"so no app"}}' ELSE '{{"name":"' || name || '","price":' || regexp_replace(CAST(value AS STRING), '\\.0$', '') || ',"eligibility":"ALL_CUSTOMERS"}}' END AS raw_text
FROM j WHERE kind = 4 OR (value > 0 AND value < 100000 AND length(name) >= 3)""")
def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of answers that are fenced, carry trailing commas or end early, with conditions, evidence and what is kept of the answer; repeats, names of digits and prices that are none go."""
    from pricewell.operators.offers import offers_from_json

    e = table(spark, sf_dir, "events").withColumn("one", F.to_json(F.struct(F.col("event_type").alias("name"), F.col("value").alias("price"), F.lit("kg").alias("unit"))))
    o = offers_from_json(e.select(F.col("event_id").alias("page_id"), F.lit(1).alias("page_number"), F.expr(_ANSWER).alias("raw")))
    blank = lambda c: F.coalesce(c, F.lit(""))
    conditions = F.array_join(F.transform("conditions", lambda c: F.concat_ws(":", c["type"], blank(c["name"]), blank(c["description"]))), ",")
    proof = F.when(F.col("evidence").isNotNull(), F.concat_ws("/", "evidence.text", "evidence.source", F.col("evidence.page").cast("string")))
    return o.select("page_id", "name", "unit", "price", "installment_count", "interest_free", "confidence", "eligibility", conditions.alias("conditions"), "eligibility_confidence", proof.alias("evidence"), "valid_from", "page_confidence", "raw_text")


@query("json_offers", f"""WITH {_JSON_SQL}, u AS (SELECT event_id // 20 AS page, name, arg_min(value, event_id) AS value FROM j WHERE value > 0 AND value < 100000 AND length(name) >= 3 GROUP BY ALL) SELECT name, count(*) AS offers, CAST(floor(sum(CAST(floor(value * 100.0 + 0.5) AS DOUBLE)) + 0.5) AS BIGINT) AS cents FROM u GROUP BY name""".replace("CASE WHEN event_id % 5 = 4 THEN 'TV ' || event_type ELSE event_type END AS name", "event_type AS name"))
def json_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of many records: of equal offers of a page the first stays."""
    from pricewell.operators.offers import offers_from_json

    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 20).alias("page_id"), "event_id", F.struct(F.col("event_type").alias("name"), F.col("value").alias("price")).alias("r"))
    pages = e.groupBy("page_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "r"))), lambda x: x["r"]).alias("offers"))).alias("raw"))
    o = offers_from_json(pages.withColumn("page_number", F.lit(1)))
    return o.groupBy("name").agg(F.count(F.lit(1)).alias("offers"), F.floor(F.sum(half_up(F.col("price") * 100)) + 0.5).cast("long").alias("cents"))


_PAGE = "upper(p_name) || chr(10) || CAST(p_size AS STRING) || 'KG' || chr(10) || 'DE ' || CAST(p_partkey % 90 + 10 AS STRING) || ',90' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' cada' END || chr(10) || 'POR ' || CAST(p_partkey % 9 + 1 AS STRING) || ',49' || chr(10) || chr(10) || '30%' || chr(10) || 'FEIJÃO ' || p_brand || chr(10) || '1 kg 12,99 8,99' || chr(10) || 'ou 3x de R$ 3,00' || chr(10) || 'TV ' || p_type || ' R$2.199,00' || chr(10) || '10x 219,90 sem juros' || CASE p_partkey % 3 WHEN 0 THEN ' no app exclusivo no app' WHEN 1 THEN ' preço clube' ELSE '' END || chr(10) || 'Oferta 5,00'"
def _put(template: str, x: str) -> str:
    return template.replace("{0}", x)


# The patterns of the line reader, as DuckDB needs them ({0} is the text).
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '" + PRICE_RE + r"', ' ', 'g'), '(?i)\bR\$\b', ' ', 'g'), '(?i)\b(DE|POR|A\s*PARTIR\.?)\b', ' ', 'g'), '\s+', ' ', 'g'))"
_NOISY = r"length({0}) < 2 OR regexp_matches({0}, '^\d+%$') OR regexp_matches({0}, '(?i)^(oferta|promo|leve|pague|validade|encarte|página)') OR regexp_matches({0}, '(?i)^(DE|POR|R\$|A\s*PARTIR)?\s*R?\$?\s*\d{1,3}(?:\.\d{3})*,\d{2}$')"
_BRL = "TRY_CAST(replace(replace({0}, '.', ''), ',', '.') AS DOUBLE)"
_PRICES = "list_filter(list_transform(regexp_extract_all({0}, '" + PRICE_RE + "', 1), lambda s: " + _BRL.replace("{0}", "s") + "), lambda p: p > 0 AND p < 100000)"
_PAIR_SQL = r"(?i)DE\s*R?\$?\s*([\d.,]+)\s*POR\s*R?\$?\s*([\d.,]+)"
_NEW_SQL = r"(?i)POR\s*R?\$?\s*([\d.,]+)"
_UNIT_SQL = r"(?i)(\d+(?:[.,]\d+)?)\s*(kg|g|ml|l|lt|un|und|unid|pack|pct|cx|fd)\b"
_PARSED = rf"""t AS (SELECT p_partkey AS page_id, list_filter(list_transform(string_split(regexp_replace({_PAGE}, '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM part),
u AS (SELECT *, list_transform(ls, lambda x: {_put(_NOISY, 'x')}) AS nz, list_transform(ls, lambda x: {_put(_PRICES, 'x')}) AS ps FROM t),
v AS (SELECT *, list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN NOT regexp_matches(ls[i], '(?i)POR') THEN 0 WHEN regexp_matches(array_to_string(ls[greatest(1, i - 5):i + 1], ' '), '{_PAIR_SQL}') THEN 1 WHEN regexp_matches(ls[i], '{_NEW_SQL}') AND i > 1 AND regexp_matches(ls[i - 1], '(?i)DE') THEN 2 ELSE 0 END) AS kd FROM u),
w AS (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM v),
x AS (SELECT *, ls[i] AS line, kd[i] AS kind, greatest(1, i - 6) AS lo, list_max(list_filter(range(greatest(1, i - 6), i), lambda j: NOT nz[j])) AS j0 FROM w WHERE kd[i] > 0 OR (NOT coalesce(kd[i + 1] > 0, false) AND len(ps[i]) > 0 AND NOT regexp_matches(ls[i], '(?i)^(ou\s+)?\d{{1,2}}\s*[xX]'))),
y AS (SELECT *, coalesce({_put(_CLEAN, "array_to_string(CASE WHEN j0 IS NULL OR len(ps[j0]) >= 2 THEN [] WHEN j0 - 1 < lo OR nz[j0 - 1] OR len(ps[j0 - 1]) >= 2 THEN ls[j0:j0] WHEN j0 - 2 < lo OR nz[j0 - 2] OR len(ps[j0 - 2]) >= 2 THEN ls[j0 - 1:j0] ELSE ls[j0 - 2:j0] END, ' ')")}, '') AS above, {_put(_CLEAN, 'line')} AS own, list_sort(ps[i], 'DESC') AS sp, array_to_string(ls[greatest(1, i - 5):i + 1], ' ') AS joined,
  array_to_string(CASE WHEN kind > 0 THEN ls[greatest(1, i - 5):i + 2] ELSE ls[greatest(1, i - 4):i + 2] END, chr(10)) AS raw FROM x),
z AS (SELECT *, len(ps[i]) >= 2 AND NOT regexp_matches(line, '(?i)\d{{1,2}}\s*[xX]\b|à\s*vista|a\s*vista') AS two FROM y),
n0 AS (SELECT *, CASE WHEN kind = 1 THEN {_put(_BRL, f"regexp_extract(joined, '{_PAIR_SQL}', 2)")} WHEN kind = 2 THEN {_put(_BRL, f"regexp_extract(line, '{_NEW_SQL}', 1)")} WHEN two AND sp[1] / sp[2] >= 1.02 THEN sp[2] WHEN two THEN ps[i][-1] ELSE ps[i][1] END AS price0, CASE WHEN kind = 1 THEN {_put(_BRL, f"regexp_extract(joined, '{_PAIR_SQL}', 1)")} WHEN kind = 2 THEN {_put(_BRL, "nullif(regexp_extract(ls[i - 1], '([0-9.,]+)', 1), '')")} WHEN two AND sp[1] / sp[2] >= 1.02 THEN sp[1] END AS original0,
  CASE WHEN kind > 0 THEN above WHEN length(own) < 3 THEN above WHEN length(above) >= 3 THEN {_put(_CLEAN, "above || ' ' || own")} ELSE own END AS name FROM z),
n1 AS (SELECT *, name || chr(10) || raw AS hay, CASE WHEN kind = 0 THEN name || chr(10) || line WHEN regexp_matches(raw, '{_UNIT_SQL}') THEN raw ELSE name END AS qsrc FROM n0 WHERE length(name) >= 3 AND (kind > 0 OR NOT regexp_matches(name, '^[0-9 .,/-]+$')))"""
_OFFERS_SQL = f"""WITH {_PARSED}, {payment_sql('n1', 'hay')}, {shape_sql('pay4', 'hay', 'price0', 'told_cash', 'original0', 'told_count', 'amount')},
f AS (SELECT *, {phrases_sql('hay')} AS hits, row_number() OVER (PARTITION BY page_id, lower(name) ORDER BY kind = 0, i) AS rn FROM shaped), g AS (SELECT *, list_transform(hits, lambda h: h.type) AS types FROM f WHERE rn = 1)
SELECT page_id, name, nullif(regexp_extract(qsrc, '{_UNIT_SQL}', 1) || lower(regexp_extract(qsrc, '{_UNIT_SQL}', 2)), '') AS quantity, {half('s_paid', 2)} AS price, {half('org', 2)} AS original_price, {half('s_cash', 2)} AS cash_price, CASE WHEN s_amt IS NOT NULL THEN s_n END AS installment_count, free AS interest_free, CASE WHEN org IS NOT NULL THEN CASE WHEN org > 0 AND s_paid < org THEN {half('(org - s_paid) / org * 1000')} / 10 ELSE 0.0 END END AS discount_percentage,
  {RANKED_SQL} AS eligibility, {half("0.9 * CASE WHEN kind > 0 THEN 1 WHEN len(list_filter(kd, lambda q: q > 0)) > 0 THEN 0.75 ELSE 0.85 END", 4)} AS confidence FROM g"""


@query("offer_parser", _OFFERS_SQL)
def offer_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers read from flyer pages made of parts: pairs on one line and on two, prices alone, instalments, eligibility."""
    from pricewell.operators.offers import parse_pages

    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.lit(1).alias("page_number"), F.expr(_PAGE).alias("text"), F.lit(0.9).alias("confidence"))
    o = parse_pages(pages)
    return o.select("page_id", "name", "quantity", *[half_up(F.col(c), 2).alias(c) for c in ("price", "original_price", "cash_price")], "installment_count", "interest_free", "discount_percentage", "eligibility", half_up(F.col("confidence"), 4).alias("confidence"))
