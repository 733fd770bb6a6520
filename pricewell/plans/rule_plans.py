"""Rules over texts and values: labels, numbers, validity, addresses, payments, eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.functions import money, parse, text
from pricewell.functions.semantics import near_money, number_of
from pricewell.operators.documents import documents_in
from pricewell.operators.filters import product_tab
from pricewell.operators.keyed import nearest_point
from pricewell.operators.offers import clean_name, noise_line
from pricewell.plans.frames import cte, frame, half, norm
from pricewell.registry import query
from pricewell.sources.tables import binary_pages, raw_json_pages, table  # noqa: F401

_BRL = "'R$ ' || translate(format('{{:,.2f}}', {0}), ',.', '.,')"
PRICE_RE = r"(\d{1,3}(?:\.\d{3})*,\d{2}|\d+,\d{2})"


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


@query("labels", f"""WITH p AS (SELECT p_partkey AS n, p_name, p_retailprice AS price, p_partkey * 37 % 20000 AS k, p_partkey % 90 AS m FROM part)
SELECT n, {_BRL.format('price')} AS brl, CASE WHEN k < 1000 THEN CAST(k AS STRING) WHEN k >= 10000 THEN CAST(CAST(floor(k / 1000.0 + 0.5) AS BIGINT) AS STRING) || 'k' ELSE regexp_replace(format('{{:.1f}}', floor(k / 100.0 + 0.5) / 10.0), '\\.0$', '') || 'k' END AS compact, format('{{:.1f}}', floor(m * 10 + 0.5) / 10.0) || '%' AS percent,
  CASE WHEN n % 4 = 0 THEN NULL WHEN n % 4 = 1 THEN '5' WHEN n % 4 = 2 THEN 'kg' ELSE '5 kg' END AS pack, CASE WHEN m < 1 THEN 'agora' WHEN m < 60 THEN 'há ' || CAST(m AS STRING) || ' min' ELSE 'há 1h' END AS ago, CASE WHEN m = 0 THEN '—' WHEN m < 60 THEN CAST(m AS STRING) || 's' ELSE '1m ' || CAST(m % 60 AS STRING) || 's' END AS took,
  CASE WHEN m % 7 = 0 THEN NULL WHEN m % 10 = 0 THEN 'Expira hoje' ELSE 'Expira em ' || CAST(m % 10 AS STRING) || 'd' END AS pill, CASE WHEN n % 5 = 0 THEN 'sem GPS' WHEN m < 10 THEN CAST(CAST(m * 100 AS BIGINT) AS STRING) || ' m' ELSE replace(format('{{:.1f}}', m / 10.0), '.', ',') || ' km' END AS distance, '3x de ' || {_BRL.format('price')} || CASE WHEN n % 2 = 0 THEN ' sem juros' ELSE '' END AS parts, CASE WHEN length(p_name) > 8 THEN p_name[1:8] || '…' ELSE p_name END AS short FROM p""")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cards and tables say: prices, sizes, times, distances, instalments."""
    n, m, k = F.col("p_partkey"), F.col("p_partkey") % 90, F.col("p_partkey") * 37 % 20000
    q, u = F.when(n % 4 == 1, " 5 ").when(n % 4 == 3, "5"), F.when(n % 4 >= 2, "kg").otherwise("")
    return _part(spark, sf_dir).select(
        n.alias("n"), text.brl(F.col("p_retailprice")).alias("brl"), text.compact(k).alias("compact"), text.percent(m / 100).alias("percent"), text.pack(q, u).alias("pack"), text.relative_label(m).alias("ago"), text.duration_label(m * 1000).alias("took"),
        text.expiry_pill((m % 10).cast("int"), m % 7 == 0).alias("pill"), text.distance_label(F.when(n % 5 != 0, m / 10)).alias("distance"), text.instalment_label(F.lit(3), F.col("p_retailprice"), n % 2 == 0).alias("parts"), text.clip(F.col("p_name"), 8, "…").alias("short"),
    )


@query("text_rules", rf"""WITH p AS (SELECT p_partkey AS n, p_name, p_brand, p_type, '  ' || p_name || chr(9) || ' x' || chr(13) || chr(10) || chr(10) || chr(10) || 'y ' AS raw, CASE p_partkey % 4 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'null' WHEN 2 THEN ' ok ' ELSE '' END AS word FROM part)
SELECT n, p_name || ' x' || chr(10) || chr(10) || 'y' AS squeezed, CASE WHEN n % 4 = 2 THEN 'ok' END AS told, p_name || ' · ' || p_type AS line, 'Olá ' || p_name || ', !' AS filled,
  CASE n % 5 WHEN 0 THEN 'SELECT_STATE' WHEN 1 THEN 'SELECT_CITY' WHEN 2 THEN 'OPEN_STORE' WHEN 3 THEN 'OPEN_FLYERS' ELSE 'NAVIGATE' END AS semantic, string_split(p_name, ' ')[1] AS first, 't:' || p_name || ':' || p_brand || ':' AS grp, {norm('p_name')} || ' 5kg' AS dedupe, p_name || ' R$' AS cleaned, n % 3 = 0 AS noise,
  CAST(CASE n % 4 WHEN 0 THEN 1234.5 WHEN 1 THEN 12.5 WHEN 2 THEN NULL ELSE 7.0 END AS DOUBLE) AS amount, CASE WHEN n % 60 BETWEEN 2 AND 48 THEN CAST(n % 60 AS INTEGER) END AS count, abs(n % 7 - 3) <= greatest(0.02, 3 * 0.03) AS near, CASE WHEN n % 101 >= 90 THEN 'HIGH' WHEN n % 101 >= 70 THEN 'MEDIUM' ELSE 'LOW' END AS band, CASE n % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE END AS value FROM p""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, numbers and words as the readers of offers see them."""
    c, n = F.col, F.col("p_partkey")
    p = _part(spark, sf_dir)
    raw = F.concat(F.lit("  "), c("p_name"), F.lit("\t x\r\n\n\ny "))
    word = F.when(n % 4 == 0, " N/A ").when(n % 4 == 1, "null").when(n % 4 == 2, " ok ").otherwise("")
    step = F.when(n % 5 == 0, "Escolha o ESTADO").when(n % 5 == 1, "sua cidade").when(n % 5 == 2, "Abrir loja").when(n % 5 == 3, "Ver encarte").otherwise("x")
    price = F.when(n % 4 == 0, "R$ 1.234,50").when(n % 4 == 1, "12.5").when(n % 4 == 2, "abc").otherwise("7")
    return p.select(
        n.alias("n"), text.squeeze_space(raw).alias("squeezed"), text.strip_unknown(word).alias("told"), text.condition_line(F.array(c("p_name"), F.lit(" "), c("p_type"), c("p_name"))).alias("line"), text.interpolate(F.lit("Olá {{name}}, {{none}}!"), {"name": c("p_name")}).alias("filled"), parse.semantic(F.lit("navigation"), step).alias("semantic"),
        text.first_word(c("p_name")).alias("first"), text.group_key(F.lit(None).cast("string"), c("p_name"), c("p_brand"), F.lit(None).cast("string")).alias("grp"), text.dedupe_key(F.concat("p_name", F.lit(" 5 KG"))).alias("dedupe"), clean_name(F.concat(F.lit("DE 10,90 POR "), c("p_name"), F.lit(" R$8,99"))).alias("cleaned"), noise_line(F.when(n % 3 == 0, "Oferta da semana").otherwise(c("p_name"))).alias("noise"),
        money.to_number(price).alias("amount"), money.instalment_count((n % 60).cast("double")).alias("count"), near_money((n % 7).cast("double"), F.lit(3.0)).alias("near"), parse.confidence_band((n % 101) / 100).alias("band"), number_of(F.when(n % 3 == 0, "1,5").when(n % 3 == 1, " ").otherwise("1.234,56")).alias("value"),
    )


@query("validity_dates", """WITH p AS (SELECT o_orderkey AS n, CAST(o_orderdate + INTERVAL 10 YEAR AS DATE) AS d FROM orders)
SELECT n, strftime(CAST(d AS TIMESTAMP) + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M') AS brazil, strftime(CAST(d AS TIMESTAMP) + INTERVAL 27 HOUR - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M') AS ends, strftime(CAST(d AS TIMESTAMP) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M') AS zoned, strftime(CAST(d AS TIMESTAMP) + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M') AS local_time, strftime(CAST(d AS TIMESTAMP), '%Y-%m-%d %H:%M') AS epoch,
  strftime(make_date(2010, month(d), day(d)) + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M') AS no_year, d < DATE '2010-06-01' AS stale, n % 4 = 0 AS archived FROM p""")
def validity_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as flyers and answers write them, to instants; titles that are over."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), F.to_date(F.col("o_orderdate") + F.expr("INTERVAL 10 YEARS")).alias("d"))
    at, d = F.lit("2010-06-01 12:00:00").cast("timestamp"), F.col("d")
    form = lambda f: F.date_format(d, f)
    told = lambda x, until=False: F.date_format(parse.parse_validity(x, at, until=until), "yyyy-MM-dd HH:mm")
    iso = F.concat(form("yyyy-MM-dd"), F.lit("T09:00:00-03:00"))
    seconds = (F.datediff(d, F.lit("1970-01-01")).cast("long") * 86400).cast("string")
    title = F.concat(F.lit("Ofertas de 01/01/1990 a "), form("dd/MM/yyyy"))
    archive = F.when(F.col("n") % 4 == 0, F.lit("Edições passadas")).otherwise(F.lit("Ofertas"))
    return o.select("n", told(form("dd/MM/yyyy")).alias("brazil"), told(form("yyyy-MM-dd"), True).alias("ends"), told(iso).alias("zoned"), told(F.concat(form("yyyy-MM-dd"), F.lit(" 00:00:00"))).alias("local_time"), told(seconds).alias("epoch"), told(form("dd/MM")).alias("no_year"), parse.stale_title(title, at).alias("stale"), parse.stale_title(archive, at).alias("archived"))


_URL = "CASE n % 12 WHEN 0 THEN 'https://a.example/encarte/semana.pdf?x=1' WHEN 1 THEN 'https://a.example/encartes/' WHEN 2 THEN 'https://a.example/encartes/natal/' WHEN 3 THEN 'https://cdn.example/pages/1.jpg' WHEN 4 THEN 'https://a.example/politica-de-privacidade.pdf' WHEN 5 THEN 'https://a.example/p#main-content' WHEN 6 THEN 'https://a.example/produto?sku=1&x=encarte/' WHEN 7 THEN 'blob:https://a/pdf-1' WHEN 8 THEN '/flyer/?id=7' WHEN 9 THEN 'https://a.example/logo.png' WHEN 10 THEN 'https://shop.b.example/folheto/x' ELSE 'https://a.example/item-3' END"
_TITLE = "CASE n % 6 WHEN 0 THEN 'Ver encarte' WHEN 1 THEN 'De 10 a 12/05' WHEN 2 THEN 'item-4' WHEN 3 THEN '' WHEN 4 THEN 'Baixar' ELSE 'Ofertas de Natal' END"


@query("url_rules", rf"""WITH p AS (SELECT p_partkey AS n FROM part), u AS (SELECT n, {_URL} AS u, {_TITLE} AS t FROM p), f AS (SELECT *, n % 12 IN (4) AS policy, n % 12 IN (1, 4, 5) AS junk FROM u)
SELECT n, policy, junk, n % 12 IN (0, 2, 8, 10) AS flyer, n % 12 = 3 AS page_image, n % 12 IN (0, 7) AS pdf, n % 12 IN (0, 1, 2, 3, 4, 5, 6, 9, 11) AS host, n % 6 IN (0, 1, 3, 4) AS junk_title, n % 6 = 2 AS placeholder, n % 12 = 0 OR n % 6 = 4 AS button, n % 12 IN (3) AND n % 2 = 1 AS bare, n % 12 IN (0, 4) OR n % 3 = 0 OR n % 3 = 1 AS rich FROM f""")
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an address is good for, and whether a title names anything."""
    n = F.col("n")
    u = _part(spark, sf_dir).select(F.col("p_partkey").alias("n")).select("n", F.expr(_URL).alias("u"), F.expr(_TITLE).alias("t"))
    pages = F.when(n % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(n % 3 == 1, F.array(F.lit("https://x/1.jpg")))
    none = F.lit(None).cast("string")
    return u.select(
        "n", parse.policy_url(F.col("u")).alias("policy"), parse.junk_url(F.col("u")).alias("junk"), parse.flyer_url(F.col("u")).alias("flyer"), parse.page_image_url(F.col("u")).alias("page_image"), parse.pdf_url(F.col("u")).alias("pdf"), parse.allowed_host(F.col("u"), ["a.example", "cdn.example"]).alias("host"),
        parse.junk_title(F.col("t")).alias("junk_title"), parse.placeholder_title(F.col("t")).alias("placeholder"), parse.download_button(F.col("t"), F.when(F.col("n") % 12 == 0, F.col("u"))).alias("button"), parse.bare_page_image(F.col("u"), none, F.lit(False), F.array().cast("array<string>")).alias("bare"), parse.rich_document(F.col("u"), F.lit(False), pages).alias("rich"),
    )


@query("address_parts", r"""SELECT page_id, url, regexp_extract_all('url(' || url || ') url("b")', 'url\(\s*[''"]?([^''")]+?)[''"]?\s*\)', 1)[1] = url AS css, CASE page_id % 4 WHEN 0 THEN '1,2,3,5' WHEN 1 THEN '4' WHEN 2 THEN '' ELSE '2,7' END AS pages FROM pages""")
def address_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in style sheets, and page ranges."""
    k = F.col("page_id") % 4
    pages = F.when(k == 0, "1-3, 5").when(k == 1, "4").when(k == 2, "x").otherwise("7,2-2")
    css = F.get(parse.css_urls(F.concat(F.lit("url("), "url", F.lit(') url("b")'))), F.lit(0))
    return table(spark, sf_dir, "pages").select("page_id", "url", (css == F.col("url")).alias("css"), F.array_join(F.transform(parse.page_set(pages), lambda x: x.cast("string")), ",").alias("pages"))


@query("page_sources", """WITH p AS (SELECT o_custkey AS flyer, o_orderkey AS n, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 4 END END AS r FROM orders), b AS (SELECT *, min(r) OVER (PARTITION BY flyer) AS best FROM p)
SELECT flyer, n, row_number() OVER (PARTITION BY flyer ORDER BY n) AS page_number FROM b WHERE r = best""")
def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each flyer's pages the best kind of source, numbered in order."""
    from pyspark.sql import Window

    k, f = F.col("o_orderkey") % 4, F.col("o_custkey")
    kind = F.when((k == 0) | ((k == 3) & (f % 3 == 0)), "capture").otherwise("url")
    kinds = F.when(k == 3, "application/pdf").otherwise("image/jpeg")
    url = F.when(k == 1, "https://x/a.pdf").otherwise("https://x/a.jpg")
    p = table(spark, sf_dir, "orders").select(f.alias("flyer"), F.col("o_orderkey").alias("n"), parse.page_source_rank(kind, kinds, url).alias("r")).filter("r IS NOT NULL")
    best = p.join(p.groupBy("flyer").agg(F.min("r").alias("best")), "flyer").filter("r = best")
    return best.select("flyer", "n", F.row_number().over(Window.partitionBy("flyer").orderBy("n")).cast("long").alias("page_number"))


@query("file_checks", """SELECT p_partkey AS n, CASE p_partkey % 6 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' WHEN 3 THEN 'application/pdf' END AS kind, CASE p_partkey % 6 WHEN 4 THEN 'unknown type' WHEN 5 THEN 'empty' END AS problem,
  CASE p_partkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'failed' WHEN 2 THEN 'failed' ELSE 'ok' END AS status, CASE p_partkey % 4 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'timeout' WHEN 2 THEN 'guard dropped 3' END AS error FROM part""")
def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and problems of downloaded files by their first bytes, and how an extraction ended."""
    n = F.col("p_partkey")
    heads = ("FFD8FFE000", "89504E470D", "524946460000000057454250", "255044462D", "00010203")
    data = F.lit(None).cast("binary")
    for k, h in enumerate(heads):
        data = F.when(n % 6 == k, F.unhex(F.lit(h))).otherwise(data)
    data = F.when(n % 6 == 5, F.unhex(F.lit(""))).otherwise(data)
    out = parse.extraction_outcome(n % 4 != 0, F.when(n % 4 == 2, 3).otherwise(0), F.lit(0), F.when(n % 4 == 1, "timeout"))
    return _part(spark, sf_dir).select(n.alias("n"), parse.content_type(data).alias("kind"), parse.file_problem(data).alias("problem"), out["status"].alias("status"), out["error"].alias("error"))


@query("recorded_steps", """SELECT event_id, CASE event_type WHEN 'view' THEN 'navigate' WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'scroll' END AS step, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN CASE WHEN event_id % 3 = 0 THEN 'SELECT_CITY' WHEN event_id % 3 = 1 THEN 'given' WHEN event_type = 'view' THEN 'NAVIGATE' END END AS semantic, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN '#a|#b' END AS selectors FROM events""")
def recorded_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded actions as steps, with their meaning and their selectors once each."""
    k, kind = F.col("event_id") % 3, F.col("event_type")
    action = F.when(kind == "view", "navigation").when(kind == "click", "click").when(kind == "purchase", "scroll").otherwise("hover")
    s = parse.recorded_step(action, F.when(k == 1, "given"), F.when(k == 0, "Sua cidade").otherwise("x"), F.array(F.lit("#a"), F.lit("#b"), F.lit("#a"), F.lit("")))
    return table(spark, sf_dir, "events").select("event_id", s.alias("s")).select("event_id", F.col("s.type").alias("step"), "s.semantic", F.array_join("s.selectors", "|").alias("selectors"))


_SHOP_TEXT = "concat('Arroz ', p_name, ' ', CAST(p_size AS STRING), ' kg DE R$ ', CAST(p_partkey % 90 + 10 AS STRING), ',90 POR ', CAST(p_partkey % 9 + 1 AS STRING), ',49 ', CASE p_partkey % 8 WHEN 0 THEN 'ou 10x de R$ 1,99 sem juros' WHEN 1 THEN 'à vista exclusivo no app' WHEN 2 THEN 'no cartão da loja' WHEN 3 THEN 'no cartão da loja aceitamos cartões visa' WHEN 4 THEN 'exclusivo do dia' WHEN 5 THEN 'leve 3 no pix com cupom BLUE10' WHEN 6 THEN 'preço clube, CPF na nota' ELSE '' END)"


def phrases_sql(x: str) -> str:
    """The phrases of a text in DuckDB: a list of (type, text), read from the same fixed table."""
    t = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    one = lambda kind, p: f"CASE WHEN regexp_matches({t}, '(?i){p}')" + (f" AND NOT regexp_matches({t}, '(?i){parse.INSTITUTIONAL}')" if kind == "STORE_CARD" else "") + f" THEN {{'type': '{kind}', 'text': trim(regexp_extract({t}, '(?i){p}'))}} END"
    hits = f"list_filter([{', '.join(one(k, p) for k, p in parse.PHRASES)}], lambda h: h IS NOT NULL)"
    hint = f"CASE WHEN regexp_matches({t}, '(?i){parse.UNKNOWN_HINT}') THEN [{{'type': 'UNKNOWN', 'text': trim(regexp_extract({t}, '(?i){parse.UNKNOWN_HINT}'))}}] ELSE [] END"
    return f"CASE WHEN len({hits}) > 0 THEN {hits} ELSE {hint} END"


RANKED_SQL = "CASE " + " ".join(f"WHEN list_contains(types, '{t}') THEN '{t}'" for t in parse.TYPE_RANK) + " ELSE 'ALL_CUSTOMERS' END"


@query("eligibility", f"WITH h AS (SELECT p_partkey, {phrases_sql(_SHOP_TEXT)} AS h FROM part), t AS (SELECT p_partkey, list_transform(h, lambda x: x.type) AS types, h[1].text AS evidence FROM h) SELECT p_partkey, {RANKED_SQL} AS type, array_to_string(list_sort(list_distinct(types)), '|') AS types, evidence FROM t")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who an offer is for, by the phrases in its text, and the first phrase as evidence."""
    p = _part(spark, sf_dir).select("p_partkey", parse.eligibility_phrases(F.expr(_SHOP_TEXT)).alias("h"))
    return p.select("p_partkey", parse.primary_type(F.col("h.type")).alias("type"), F.array_join(F.array_sort(F.array_distinct("h.type")), "|").alias("types"), F.get("h", F.lit(0))["text"].alias("evidence"))


_AI = "ai AS (SELECT p_partkey AS n, CASE p_partkey % 4 WHEN 0 THEN 'APP_ONLY' WHEN 1 THEN 'ALL_CUSTOMERS' WHEN 2 THEN 'UNKNOWN' END AS kind, p_partkey % 3 = 0 AS proven, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey % 101) / 100.0::DOUBLE END AS conf, CASE WHEN p_partkey % 7 = 0 THEN ['CPF_REQUIRED'] ELSE [] END AS told, CASE WHEN p_partkey % 6 = 5 THEN ['STORE_CARD'] ELSE [] END AS rules FROM part)"


@query("resolved_eligibility", f"""WITH {_AI}, a AS (SELECT *, CASE WHEN kind IS NOT NULL AND kind <> 'ALL_CUSTOMERS' AND NOT proven THEN CASE WHEN len(told) = 0 THEN 'UNKNOWN' END ELSE kind END AS k2, CASE WHEN proven THEN told ELSE [] END AS t2 FROM ai),
b AS (SELECT *, coalesce(k2 <> 'ALL_CUSTOMERS', false) AS claims, CASE WHEN len(rules) > 0 THEN rules || t2 WHEN proven AND len(t2) > 0 THEN t2 WHEN proven AND coalesce(k2 <> 'ALL_CUSTOMERS', false) THEN [k2] ELSE [] END AS types FROM a),
c AS (SELECT *, CASE WHEN len(rules) > 0 THEN CASE WHEN claims AND list_contains(types, k2) AND conf IS NOT NULL THEN greatest(0.92, conf) ELSE 0.92 END WHEN proven AND (len(t2) > 0 OR claims) THEN coalesce(conf, 0.75) WHEN k2 = 'UNKNOWN' THEN coalesce(conf, 0.42) ELSE coalesce(conf, 0.91) END AS c1 FROM b),
d AS (SELECT *, CASE WHEN len(types) > 0 THEN {RANKED_SQL} WHEN k2 = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'ALL_CUSTOMERS' END AS final FROM c), e AS (SELECT *, CASE WHEN final = 'UNKNOWN' AND len(types) = 0 THEN least(c1, 0.5) ELSE c1 END AS sure FROM d)
SELECT n, final AS type, array_to_string(types, '|') AS types, {half('sure', 4)} AS confidence, CASE WHEN sure >= 0.9 THEN 'ai_validated' ELSE 'review_required' END AS status FROM e""")
def resolved_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases win over a model's answer, which counts only with evidence."""
    from pricewell.functions.semantics import half_up

    n = F.col("p_partkey")
    none = F.array().cast("array<string>")
    r = parse.resolve_eligibility(F.when(n % 6 == 5, F.array(F.lit("STORE_CARD"))).otherwise(none), F.when(n % 4 == 0, "APP_ONLY").when(n % 4 == 1, "ALL_CUSTOMERS").when(n % 4 == 2, "UNKNOWN"), F.when(n % 7 == 0, F.array(F.lit("CPF_REQUIRED"))).otherwise(none), F.when(n % 5 != 0, (n % 101) / 100), F.when(n % 3 == 0, "told"))
    return _part(spark, sf_dir).select(n.alias("n"), r.alias("r")).select("n", "r.type", F.array_join("r.types", "|").alias("types"), half_up(F.col("r.confidence"), 4).alias("confidence"), "r.status")


@query("unique_conditions", """SELECT p_partkey AS n, CASE WHEN p_partkey % 2 = 0 THEN 'APP_ONLY:' || p_brand || '|CPF_REQUIRED:' ELSE '' END AS conditions, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE substr(repeat(p_name, 40), 1, 400) || '@' || CASE WHEN p_partkey % 3 = 1 THEN 'flyer' ELSE 'page' END || '@9' END AS evidence FROM part""")
def unique_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's conditions: known types, once each; and its evidence, clipped."""
    n, null = F.col("p_partkey"), F.lit(None).cast("string")
    c = lambda t, name: F.struct(F.lit(t).alias("type"), name.alias("name"), null.alias("description"), null.alias("requirement"))
    raw = F.when(n % 2 == 0, F.array(c("APP_ONLY", F.col("p_brand")), c("ALL_CUSTOMERS", null), c("CPF_REQUIRED", F.lit(" ")), c("APP_ONLY", F.lower("p_brand")), c("OTHER", null)))
    told = F.array_join(F.transform(parse.unique_conditions(raw), lambda x: F.concat(x["type"], F.lit(":"), F.coalesce(x["name"], F.lit("")))), "|")
    e = parse.evidence(F.when(n % 3 != 0, F.repeat("p_name", 40)).otherwise(" "), F.when(n % 3 == 1, "").otherwise("page"), F.lit(None).cast("int"), F.lit(9))
    return _part(spark, sf_dir).select(n.alias("n"), told.alias("conditions"), F.concat_ws("@", e["text"], e["source"], e["page"].cast("string")).alias("e")).select("n", "conditions", F.nullif("e", F.lit("")).alias("evidence"))


def payment_sql(source: str, text: str) -> str:
    """CTEs pay1 … pay3 over ``source``: what ``text`` tells about payment."""
    return rf"""pay1 AS (SELECT *, regexp_extract({text}, '(\d{{1,2}})\s*[xX]\s*(?:de\s*)?(?:R\$\s*)?(\d{{1,3}}(?:\.\d{{3}})*,\d{{2}}|\d+,\d{{2}})', ['c', 'a']) AS nx,
  list_filter(list_transform(regexp_extract_all({text}, '{PRICE_RE}', 1), lambda s: CAST(replace(replace(s, '.', ''), ',', '.') AS DOUBLE)), lambda p: p > 0 AND p < 100000) AS all_prices FROM {source}),
pay2 AS (SELECT *, TRY_CAST(replace(replace(nx.a, '.', ''), ',', '.') AS DOUBLE) AS amount, CASE WHEN TRY_CAST(nx.c AS INTEGER) BETWEEN 2 AND 48 THEN TRY_CAST(nx.c AS INTEGER) END AS count FROM pay1),
pay3 AS (SELECT *, CASE WHEN amount IS NULL THEN all_prices ELSE list_filter(all_prices, lambda p: NOT abs(p - amount) <= greatest(0.02, abs(amount) * 0.03)) END AS others FROM pay2),
pay4 AS (SELECT *, CASE WHEN regexp_matches({text}, '(?i)à\s*vista|a\s*vista') OR (amount IS NOT NULL AND len(all_prices) > 1) THEN coalesce(CASE WHEN amount IS NULL THEN others[1] ELSE list_filter(others, lambda p: p > amount)[1] END, others[1]) END AS told_cash, CASE WHEN amount IS NOT NULL THEN count END AS told_count, CASE WHEN regexp_matches({text}, '(?i)sem\s+juros') THEN true END AS free FROM pay3)"""


def shape_sql(source: str, text: str, price: str, cash: str, original: str, count: str, amount: str) -> str:
    """CTE shaped over ``source``: paid, cash, org, n and amt."""
    ok = lambda x: f"CASE WHEN {x} > 0 AND {x} < 100000 THEN {x} END"
    return rf"""sh1 AS (SELECT *, {ok(amount)} AS s_amt, {ok(cash)} AS s_cash, {count} AS s_n, {ok(original)} AS s_org, {ok(price)} AS s_price FROM {source}),
sh2 AS (SELECT *, coalesce(s_cash, {half('s_n * s_amt', 2)}, s_price) AS s_paid, regexp_matches({text}, '(?is)\bDE\b.{{0,80}}\bPOR\b') AS s_pair FROM sh1),
shaped AS (SELECT *, CASE WHEN NOT (coalesce(NOT s_pair AND (abs(s_org - s_n * s_amt) <= greatest(0.02, abs(s_n * s_amt) * 0.03)), false) OR coalesce(NOT s_pair AND abs(s_org - s_amt) <= greatest(0.02, abs(s_amt) * 0.03), false) OR coalesce(s_org < s_paid, false)) THEN s_org END AS org FROM sh2 WHERE s_paid > 0 AND s_paid < 100000)"""


@query("payment_shape", f"WITH src AS (SELECT p_partkey, {_SHOP_TEXT} AS t, p_partkey % 9 + 1.49::DOUBLE AS price, p_partkey % 90 + 10.9::DOUBLE AS original FROM part), {payment_sql('src', 't')}, {shape_sql('pay4', 't', 'price', 'told_cash', 'original', 'told_count', 'amount')} SELECT p_partkey, {half('s_paid', 2)} AS price, {half('s_cash', 2)} AS cash_price, {half('org', 2)} AS original_price, CASE WHEN s_amt IS NOT NULL THEN s_n END AS installment_count, CASE WHEN s_n IS NOT NULL THEN s_amt END AS installment_amount, free AS interest_free FROM shaped")
def payment_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a text tells about payment, and the price that follows from it."""
    from pricewell.functions.semantics import half_up

    n = F.col("p_partkey")
    p = _part(spark, sf_dir).select(n, F.expr(_SHOP_TEXT).alias("t"), (n % 9 + F.lit(1.49)).alias("price"), (n % 90 + F.lit(10.9)).alias("original")).withColumn("p", money.payment_from_text(F.col("t")))
    s = p.withColumn("s", money.shape_payment(F.col("price"), F.col("p.cash_price"), F.col("original"), F.col("p.installment_count"), F.col("p.installment_amount"), F.col("t")))
    return s.select("p_partkey", *[half_up(F.col(f"s.{c}"), 2).alias(c) for c in ("price", "cash_price", "original_price")], "s.installment_count", "s.installment_amount", "p.interest_free")


@query("nearest_points", """WITH p AS (SELECT CAST(p_size AS DOUBLE) * 7 + p_partkey % 3 AS x FROM part), q AS (SELECT c_custkey AS k, c_acctbal AS t FROM customer), d AS (SELECT k, t, x, row_number() OVER (PARTITION BY k ORDER BY abs(t - x), x) AS r FROM q, (SELECT DISTINCT x FROM p)) SELECT t AS at, x AS nearest FROM d WHERE r = 1""")
def nearest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each balance with the nearest of some marks; of two equally near the lower."""
    p = _part(spark, sf_dir).select((F.col("p_size").cast("double") * 7 + F.col("p_partkey") % 3).alias("x"))
    return nearest_point(p, "x", table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("at")), "at")


@query("json_documents", """SELECT event_id, 'https://x/' || CAST(event_id AS STRING) || '.pdf' AS url, 'T' || event_type AS title, CAST(NULL AS BIGINT) AS pages, true AS pdf FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'https://x/1.jpg', event_type, 2, false FROM events WHERE event_id % 3 = 1""")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in nested answers of unknown shape."""
    k, kind = F.col("event_id"), F.col("event_type")
    one = F.concat(F.lit('{"data":{"flyers":[{"pdfUrl":"https://x/'), k.cast("string"), F.lit('.pdf","name":"T'), kind, F.lit('"}]}}'))
    two = F.concat(F.lit('[{"a":[{"title":"'), kind, F.lit('","images":["https://x/1.jpg",{"url":"https://x/2.jpg"}]}]}]'))
    raw = F.when(k % 3 == 0, one).when(k % 3 == 1, two).otherwise("no json")
    d = documents_in(table(spark, sf_dir, "events").select("event_id", raw.alias("body")))
    return d.select("event_id", "url", "title", F.size("page_urls").cast("long").alias("pages"), "pdf")


_RECORDED = (
    "'https://cdn.example/' || CASE WHEN event_id % 7 = 6 THEN 'analytics/' ELSE '' END || CAST(event_id % 300 AS STRING) || CASE event_id % 7 WHEN 0 THEN '.pdf?v=1' WHEN 1 THEN '.jpg' ELSE '' END AS url",
    "CASE WHEN event_id % 11 = 0 THEN 404 ELSE 200 END AS status",
    "CASE event_id % 7 WHEN 0 THEN 'application/octet-stream' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'text/html' ELSE 'Application/JSON; charset=utf-8' END AS content_type",
    """CASE event_id % 7 WHEN 0 THEN 'x' WHEN 1 THEN 'y' WHEN 2 THEN '%PDF-1.7 by its bytes' ELSE '{"flyers":[{"title":"T' || CAST(event_id % 40 AS STRING) || '","images":["https://cdn.example/a.jpg","https://cdn.example/b.png"]}]}' END AS body""",
    "event_id AS seq",
)


@query("harvested_documents", f"""WITH r AS (SELECT {', '.join(_RECORDED)} FROM events), ok AS (SELECT *, seq % 7 AS k FROM r WHERE status = 200),
d AS (SELECT url, NULL AS title, 0 AS pages, true AS pdf, seq FROM ok WHERE k IN (0, 2) UNION ALL SELECT 'https://cdn.example/a.jpg', 'T' || CAST(seq % 40 AS STRING), 2, false, seq FROM ok WHERE k IN (3, 4, 5))
SELECT url, title, pages, pdf, count(*) = 1 AS once FROM (SELECT DISTINCT url, title, pages, pdf FROM d) GROUP BY ALL""")
def harvested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a crawl's recorded responses, written as JSON lines and read again: by header, by bytes and from answers, each once."""
    from pricewell.operators.documents import harvest, recorded_responses
    from pricewell.sources.scratch import new_folder

    path = new_folder(spark, "responses")
    table(spark, sf_dir, "events").selectExpr(*_RECORDED).withColumn("body", F.base64(F.encode("body", "utf-8"))).write.json(path)
    h = harvest(recorded_responses(spark, path)).select("url", "title", F.coalesce(F.size("page_urls"), F.lit(0)).alias("_n"), "pdf")
    return h.groupBy("url", "title", F.greatest("_n", F.lit(0)).alias("pages"), "pdf").agg((F.count(F.lit(1)) == 1).alias("once"))


@query("product_tabs", f"""WITH {cte('offers')}, m AS (SELECT canonical_product_id AS id, count(DISTINCT supermarket_id) AS markets, CASE WHEN min(price) > 0 THEN {half('(max(price) - min(price)) / min(price) * 100', 1)} END AS spread FROM offers WHERE canonical_product_id IS NOT NULL GROUP BY 1) SELECT id, markets = 1 AS single, markets >= 2 AS multi, coalesce(spread > 40, false) AS spread FROM m""")
def product_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricewell.functions.semantics import spread_pct

    m = frame(spark, sf_dir, "offers").filter("canonical_product_id IS NOT NULL").groupBy(F.col("canonical_product_id").alias("id")).agg(F.count_distinct("supermarket_id").alias("markets"), F.min("price").alias("lo"), F.max("price").alias("hi"))
    return m.select("id", *[product_tab(t, F.col("markets"), spread_pct(F.col("lo"), F.col("hi"))).alias(t) for t in ("single", "multi", "spread")])
