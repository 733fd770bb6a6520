"""Offers: normalisation, brands, products, verdicts, fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.functions.semantics import club_fields, half_up
from pricewell.functions.text import match_key, normalize, slug
from pricewell.operators import filters, resolve
from pricewell.operators.joins import own_page_or_unpaged
from pricewell.operators.keyed import strip_around
from pricewell.operators.listing import condition_drafts, offer_list, public_condition
from pricewell.plans.frames import cte, day, frame, half, norm, number, title, unit
from pricewell.registry import query

AT = "2001-06-15"
_AT = f"TIMESTAMP '{AT}'"


def _as_of():
    return F.lit(AT).cast("timestamp_ntz")


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.lit("APP_ONLY").alias("type"), F.col("condition_name").alias("name"), F.lit(" no app ").alias("description"), F.lit(None).cast("string").alias("requirement"))
    none = F.array().cast("array<struct<type:string,name:string,description:string,requirement:string>>")
    return frame(spark, sf_dir, "offers").withColumn("conditions", F.when(F.col("condition_name").isNotNull(), F.array(one)).otherwise(none))


_CLUB = "eligibility IS NOT NULL AND eligibility <> 'ALL_CUSTOMERS'"
_NORMAL = f"""normal AS (SELECT *, {norm('name')} AS nname, CASE WHEN brand <> '' THEN {title('brand')} END AS nbrand, CASE WHEN quantity <> '' THEN {number('quantity')} END AS qvalue, {unit('unit')} AS nunit, {_CLUB} AS club FROM offers)"""


@query("normalized_offers", f"""WITH {cte('offers')}, {_NORMAL} SELECT id, nname AS normalized_name, nbrand AS normalized_brand, qvalue AS quantity_value, nunit AS unit_normalized, coalesce(club, false) AS requires_membership,
  CASE WHEN club THEN price END AS member_price, CASE WHEN club THEN coalesce(original_price, price) ELSE price END AS public_price, CASE WHEN club THEN coalesce(condition_name, eligibility) END AS membership_name FROM normal""")
def normalized_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, brands, quantities and units normalised, with public and members' prices."""
    n = resolve.normalize_offers(_offers(spark, sf_dir))
    return n.select("id", "normalized_name", "normalized_brand", "quantity_value", "unit_normalized", "requires_membership", "member_price", "public_price", "membership_name")


@query("backfilled_offers", f"WITH {cte('offers')}, {_NORMAL} SELECT id, CASE WHEN n % 2 = 0 THEN nname ELSE normalized_name END AS normalized_name, CASE WHEN n % 2 = 0 THEN qvalue END AS quantity_value FROM normal")
def backfilled_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers that were not normalised yet get their names and quantities, and no members' fields."""
    o = frame(spark, sf_dir, "offers").withColumn("quantity_value", F.lit(None).cast("double"))
    new = resolve.normalize_offers(o.filter("n % 2 = 0"), members=False).select("id", "normalized_name", "quantity_value")
    return o.filter("n % 2 <> 0").select("id", "normalized_name", "quantity_value").unionByName(new)


_BRANDS = f"""seen AS (SELECT p_brand AS name, min(p_partkey) AS first FROM part GROUP BY p_brand), brands AS (SELECT 'a:' || name AS id, name, replace({norm('name')}, ' ', '-') AS slug FROM seen WHERE first % 3 = 0 UNION ALL SELECT 'b:' || name, name, replace({norm('name')}, ' ', '-') FROM seen WHERE first % 6 = 0),
aliases AS (SELECT 'alias:' || name AS id, CASE WHEN first % 2 = 0 THEN lower(strip_accents(name)) ELSE {norm('name')} END AS plain FROM seen WHERE first % 3 = 1)"""
_BRANDED = f"""branded AS (SELECT normal.*, coalesce(a.id, l.id, sha256(s.slug)) AS brand_id, s.slug AS bslug, a.id IS NULL AND l.id IS NULL AND s.slug IS NOT NULL AS fresh
  FROM (SELECT *, replace({norm('nbrand')}, ' ', '-') AS slug FROM normal) s JOIN normal USING (id) LEFT JOIN (SELECT slug, min(id) AS id FROM brands GROUP BY slug) a ON a.slug = s.slug LEFT JOIN aliases l ON l.plain = lower(strip_accents(s.nbrand)))"""


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands known by slug (some twice), and others by an alias only, which is the name or only its words."""
    from pricewell.sources.tables import table

    seen = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("first"))
    none = F.array().cast("array<string>")
    own = lambda cond, mark: seen.filter(cond).select(F.concat(F.lit(mark), "name").alias("id"), "name", slug(F.col("name")).alias("slug"), none.alias("aliases"))
    named = seen.filter("first % 3 = 1").select(F.concat(F.lit("alias:"), "name").alias("id"), F.lit("Other").alias("name"), F.concat(F.lit("other-"), "name").alias("slug"), F.array(F.when(F.col("first") % 2 == 0, F.upper("name")).otherwise(normalize(F.col("name")))).alias("aliases"))
    return own("first % 3 = 0", "a:").unionByName(own("first % 6 = 0", "b:")).unionByName(named)


@query("ensured_brands", f"WITH {cte('offers')}, {_NORMAL}, {_BRANDS}, {_BRANDED} SELECT id, brand_id FROM branded")
def ensured_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each offer's brand: by slug, else by alias, else a new one."""
    offers, _ = resolve.ensure_brands(resolve.normalize_offers(_offers(spark, sf_dir)), _brands(spark, sf_dir))
    return offers.select("id", "brand_id")


@query("new_brands", f"WITH {cte('offers')}, {_NORMAL}, {_BRANDS}, {_BRANDED} SELECT brand_id AS id, min(nbrand) AS name, bslug AS slug FROM branded WHERE fresh GROUP BY brand_id, bslug")
def new_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, new = resolve.ensure_brands(resolve.normalize_offers(_offers(spark, sf_dir)), _brands(spark, sf_dir))
    return new.select("id", "name", "slug")


_KEYED = f"keyed AS (SELECT *, concat_ws('|', {norm('name')}, {norm('nbrand')}, CASE WHEN quantity <> '' THEN regexp_replace(quantity, '^([^,]*),', '\\1.') END, CASE WHEN unit <> '' THEN nunit END) AS mkey FROM normal)"
_RESOLVED = """products AS (SELECT mkey AS match_key, min('q' || id) AS id FROM keyed WHERE n % 4 = 0 GROUP BY mkey), resolved AS (SELECT k.*, coalesce(p.id, sha256(mkey)) AS product_id, p.id IS NULL AS fresh FROM keyed k LEFT JOIN products p ON p.match_key = k.mkey)"""


def _products(n: DataFrame) -> DataFrame:
    """The products of every fourth offer; equal keys come several times."""
    key = match_key(F.col("name"), F.col("normalized_brand"), F.col("quantity"), F.col("unit"))
    return n.filter("n % 4 = 0").select(F.concat(F.lit("q"), "id").alias("id"), key.alias("match_key"), F.lit("2000-01-01").cast("timestamp_ntz").alias("created_at"))


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = resolve.normalize_offers(_offers(spark, sf_dir)).withColumn("brand_id", F.lit(None).cast("string"))
    return resolve.resolve_products(n, _products(n))


@query("canonical_resolution", f"WITH {cte('offers')}, {_NORMAL}, {_KEYED}, {_RESOLVED} SELECT id, product_id AS canonical_product_id FROM resolved")
def canonical_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each offer's product, by match key; an unknown key makes a new product."""
    return _resolved(spark, sf_dir)[0].select("id", "canonical_product_id")


@query("new_products", f"WITH {cte('offers')}, {_NORMAL}, {_KEYED}, {_RESOLVED} SELECT product_id AS id, arg_min(name, id) AS canonical_name, replace({norm('arg_min(name, id)')}, ' ', '-') AS slug, arg_min(coalesce(nunit, '-'), id) AS unit, mkey AS match_key FROM resolved WHERE fresh GROUP BY product_id, mkey")
def new_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first offer of an unknown key supplies the product."""
    return _resolved(spark, sf_dir)[1].select("id", "canonical_name", "slug", F.coalesce("unit", F.lit("-")).alias("unit"), "match_key")


@query("new_price_rows", f"WITH {cte('offers')}, {_NORMAL}, {_KEYED}, {_RESOLVED} SELECT sha256(id) AS id, product_id AS canonical_product_id, id AS offer_id, price, CASE WHEN club THEN price END AS member_price, CASE WHEN club THEN eligibility END AS membership_name FROM resolved WHERE n % 5 <> 0")
def new_price_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price row for each offer without one."""
    offers, _ = _resolved(spark, sf_dir)
    rows = resolve.new_price_rows(offers, offers.filter("n % 5 = 0").select(F.col("id").alias("offer_id")))
    return rows.select("id", "canonical_product_id", "offer_id", "price", "member_price", "membership_name")


_VERDICT = """CASE WHEN length({n}) < 4 OR price <= 0 THEN 'rejected' WHEN coalesce(confidence, 0.7) < 0.5 THEN 'rejected' WHEN coalesce(confidence, 0.7) >= 0.8 AND price BETWEEN 0.1 AND 5000 THEN 'validated' WHEN price NOT BETWEEN 0.1 AND 5000 THEN 'suspicious' ELSE 'validated' END"""


@query("processed_offers", f"""WITH {cte('offers')}, {_NORMAL}, {_BRANDS}, {_BRANDED}, {_KEYED}, {_RESOLVED}
SELECT b.id, b.brand_id, r.product_id AS canonical_product_id, CASE WHEN b.validation_status = 'pending' THEN {_VERDICT.format(n='b.nname').replace('price', 'b.price').replace('confidence', 'b.confidence')} ELSE b.validation_status END AS validation_status FROM branded b JOIN resolved r ON r.id = b.id""")
def processed_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way of a flyer's offers: normalised, branded, resolved, and the pending ones judged."""
    o = _offers(spark, sf_dir)
    products = _products(resolve.normalize_offers(o))
    done, *_ = resolve.process_offers(o, _brands(spark, sf_dir), products, spark.createDataFrame([], "offer_id string"))
    return done.select("id", "brand_id", "canonical_product_id", "validation_status")


@query("validated_counts", f"""WITH {cte('offers')}, v AS (SELECT flyer_id, validation_status AS before, CASE WHEN validation_status = 'pending' THEN {_VERDICT.format(n='normalized_name')} ELSE validation_status END AS after FROM offers)
SELECT flyer_id, count(*) FILTER (WHERE before = 'pending' AND after = 'validated') AS validated, count(*) FILTER (WHERE before = 'pending' AND after = 'suspicious') AS suspicious, count(*) FILTER (WHERE before = 'pending' AND after = 'rejected') AS rejected, count(*) AS total FROM v GROUP BY flyer_id""")
def validated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the verdicts on pending offers came to, by flyer."""
    o = frame(spark, sf_dir, "offers")
    v = resolve.validate_pending(o.withColumn("before", F.col("validation_status"))).filter("before IS NOT NULL")
    fresh = F.col("before") == "pending"
    return v.groupBy("flyer_id").agg(*[F.count_if(fresh & (F.col("validation_status") == s)).alias(s) for s in ("validated", "suspicious", "rejected")], F.count(F.lit(1)).alias("total"))


_LINKED = "linked AS (SELECT id, n, CASE WHEN n % 2 = 0 THEN 'b' || CAST(n % 7 AS STRING) END AS brand_id, canonical_product_id FROM offers)"


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "offers").withColumn("brand_id", F.when(F.col("n") % 2 == 0, F.concat(F.lit("b"), (F.col("n") % 7).cast("string"))))


@query("merged_brand", f"WITH {cte('offers')}, {_LINKED} SELECT 'offer' AS what, id, CASE WHEN brand_id = 'b1' THEN 'b2' ELSE brand_id END AS told FROM linked UNION ALL SELECT * FROM (VALUES ('brand', 'b2', 'two|deux|one|un'), ('brand', 'b3', '')) t(what, id, told)")
def merged_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One brand goes into another, which takes over its name and aliases."""
    brands = spark.createDataFrame([("b1", "one", "one", ["un", "deux"]), ("b2", "two", "two", ["two", "deux"]), ("b3", "three", "three", None)], "id string, name string, slug string, aliases array<string>")
    offers, _, left = resolve.merge_brand(_linked(spark, sf_dir), spark.createDataFrame([], "id string, brand_id string"), brands, "b1", "b2")
    told = left.select(F.lit("brand").alias("what"), "id", F.coalesce(F.array_join("aliases", "|"), F.lit("")).alias("told"))
    return offers.select(F.lit("offer").alias("what"), "id", F.col("brand_id").alias("told")).unionByName(told)


@query("merged_product", f"WITH {cte('offers')}, {_LINKED} SELECT id, CASE WHEN canonical_product_id = 'p1' THEN 'p2' ELSE canonical_product_id END AS canonical_product_id, CASE WHEN canonical_product_id = 'p1' THEN coalesce(brand_id, 'bx') ELSE brand_id END AS brand_id FROM linked")
def merged_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product goes into another; its offers without a brand take the other's."""
    o = _linked(spark, sf_dir)
    products = spark.createDataFrame([("p1", "by"), ("p2", "bx")], "id string, brand_id string")
    offers, _, _ = resolve.merge_product(o, o.select("id", "canonical_product_id"), products, "p1", "p2")
    return offers.select("id", "canonical_product_id", "brand_id")


@query("unlinked_offer", f"WITH {cte('offers')} SELECT id, CASE WHEN id <> '4' THEN canonical_product_id END AS canonical_product_id, id <> '4' AS priced FROM offers")
def unlinked_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An offer loses its product and its price row."""
    o = frame(spark, sf_dir, "offers")
    offers, history = resolve.unlink_offer(o, o.select(F.col("id").alias("offer_id")), "4")
    return offers.join(history.select(F.col("offer_id").alias("id"), F.lit(True).alias("p")), "id", "left").select("id", "canonical_product_id", F.coalesce("p", F.lit(False)).alias("priced"))


@query("eligibility_audit", f"WITH {cte('offers')} SELECT id AS offer_id, eligibility AS previous, 'CPF_REQUIRED' AS new, confidence AS previous_confidence, 0.9::DOUBLE AS new_confidence, 'manual' AS source, 'CPF_REQUIRED' AS now FROM offers WHERE n % 9 = 4")
def eligibility_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed eligibilities, each with its audit row."""
    o = frame(spark, sf_dir, "offers").withColumn("eligibility_confidence", F.col("confidence"))
    changes = o.filter("n % 9 = 4").select("id", F.lit("CPF_REQUIRED").alias("eligibility"), F.lit(0.9).alias("confidence"), F.lit("manual").alias("source"))
    after, audit = resolve.set_eligibility(o, changes)
    return audit.join(after.select(F.col("id").alias("offer_id"), F.col("eligibility").alias("now")), "offer_id")


@query("health_fix", f"""WITH {cte('offers')}, {_LINKED}, q AS (SELECT id FROM offers WHERE n % 5 <= 1), nx AS (SELECT count(*) AS pending, coalesce(min(id) FILTER (WHERE id > '15'), min(id)) AS next FROM q)
SELECT o.id, CASE WHEN o.n % 9 = 4 THEN 'b9' ELSE l.brand_id END AS brand_id, CASE WHEN o.n % 9 = 5 THEN '2,5' ELSE quantity END AS quantity, CASE WHEN o.n % 9 = 5 THEN 2.5 ELSE CASE WHEN quantity <> '' THEN {number('quantity')} END END AS quantity_value, CASE WHEN o.n % 9 = 5 THEN 'kg' ELSE {unit('unit')} END AS unit_normalized, pending, nullif(next, '15') AS next FROM offers o JOIN linked l ON l.id = o.id, nx""")
def health_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes of brand and pack, with the queue's length and what follows offer 15 in it."""
    o = resolve.normalize_offers(_linked(spark, sf_dir), members=False)
    fixes = o.filter("n % 9 IN (4, 5)").select("id", F.when(F.col("n") % 9 == 4, "b9").alias("brand_id"), F.when(F.col("n") % 9 == 5, "2,5").alias("quantity"), F.when(F.col("n") % 9 == 5, "Kilos").alias("unit"))
    after, _ = resolve.apply_fix(o, spark.createDataFrame([], "id string, brand_id string, quantity string, unit string"), fixes)
    queue = frame(spark, sf_dir, "offers").filter(filters.lacks_brand(F.lit(None).cast("string"), F.col("brand"))).select("id")
    return after.select("id", "brand_id", "quantity", "quantity_value", "unit_normalized").crossJoin(F.broadcast(resolve.next_in_queue(queue, "15")))


@query("fix_queues", f"""WITH {cte('offers')}, v AS (SELECT *, CASE WHEN quantity <> '' THEN {number('quantity')} END AS qv, {unit('unit')} AS un FROM offers)
SELECT 'brand' AS fix, 'Marca ausente' AS reason, id, coalesce(brand, '—') AS detail FROM v WHERE brand IS NULL OR brand = '' UNION ALL SELECT 'qty', 'Quantidade ausente', id, coalesce(unit, '—') FROM v WHERE (quantity IS NULL OR quantity = '') AND (qv IS NULL OR qv = 0)
UNION ALL SELECT 'unit', 'Unidade inválida', id, coalesce(unit, '—') FROM v WHERE unit <> '' AND un IS NULL AND (qv IS NULL OR qv = 0)""")
def fix_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lacks a brand, a quantity or a known unit, each offer with its reasons; one scan feeds the three queues."""
    n = resolve.normalize_offers(frame(spark, sf_dir, "offers"), members=False)
    none = F.lit(None).cast("string")
    tests = {"brand": (filters.lacks_brand(none, F.col("brand")), F.col("brand")), "qty": (filters.lacks_quantity(F.col("quantity"), F.col("quantity_value")), F.col("unit")), "unit": (filters.lacks_unit(F.col("unit"), F.col("unit_normalized"), F.col("quantity_value")), F.col("unit"))}
    item = lambda fix: F.when(tests[fix][0], F.struct(F.lit(fix).alias("fix"), F.coalesce(tests[fix][1], F.lit("—")).alias("detail")))
    items = n.select("id", F.explode(F.filter(F.array(*map(item, tests)), lambda x: x.isNotNull())).alias("i")).select("i.fix", "id", "i.detail")
    return items.select("fix", filters.fix_reason(F.col("fix")).alias("reason"), "id", "detail")


@query("fix_strip", f"WITH {cte('offers')}, q AS (SELECT n AS pos, row_number() OVER (ORDER BY n) AS r FROM offers WHERE n % 5 <= 1) SELECT pos FROM q WHERE r BETWEEN (SELECT greatest(r - 1, 1) FROM q WHERE pos = 15) AND (SELECT greatest(r - 1, 1) + 3 FROM q WHERE pos = 15)")
def fix_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four items of the queue around the current one."""
    return strip_around(frame(spark, sf_dir, "offers").filter("n % 5 <= 1").select(F.col("n").alias("pos")), "pos", 15)


@query("fix_context", f"""WITH {cte('offers')}, {_NORMAL}, k AS (SELECT canonical_product_id AS pid, min(name) AS cname, min(quantity) AS cq, min(nunit) AS cu, count(DISTINCT supermarket_id) FILTER (WHERE (valid_from IS NULL OR valid_from <= {_AT}) AND (valid_until IS NULL OR valid_until >= {_AT})) AS active_markets, min(price) FILTER (WHERE (valid_from IS NULL OR valid_from <= {_AT}) AND (valid_until IS NULL OR valid_until >= {_AT})) AS min_price, count(*) AS offer_count FROM normal WHERE canonical_product_id IS NOT NULL GROUP BY 1)
SELECT id, coalesce(active_markets, 0) AS active_markets, min_price, coalesce(offer_count, 0) AS offer_count, CASE WHEN pid IS NULL OR {norm('name')} = {norm('cname')} THEN 'ok' ELSE 'review' END AS compare_name,
  CASE WHEN pid IS NULL OR {norm("concat_ws(' ', nullif(quantity, ''), nullif(coalesce(nunit, unit), ''))")} = {norm("concat_ws(' ', nullif(cq, ''), nullif(cu, ''))")} THEN 'ok' ELSE 'review' END AS compare_unit, 'fix' AS compare_brand FROM normal LEFT JOIN k ON pid = canonical_product_id WHERE brand IS NULL OR brand = ''""")
def fix_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers without a brand beside their product: its live markets, lowest live price and offers, and which fields differ."""
    from pricewell.functions.semantics import valid_at
    from pricewell.functions.text import normalize

    n = resolve.normalize_offers(frame(spark, sf_dir, "offers"), members=False)
    live = valid_at(_as_of(), F.col("valid_from"), F.col("valid_until"))
    k = n.filter("canonical_product_id IS NOT NULL").groupBy("canonical_product_id").agg(F.min("name").alias("cname"), F.min("quantity").alias("cq"), F.min("unit_normalized").alias("cu"), F.count_distinct(F.when(live, F.col("supermarket_id"))).alias("active_markets"), F.min(F.when(live, F.col("price"))).alias("min_price"), F.count(F.lit(1)).alias("offer_count"))
    pack = lambda q, u: normalize(F.concat_ws(" ", F.nullif(q, F.lit("")), F.nullif(u, F.lit(""))))
    m = n.filter(filters.lacks_brand(F.lit(None).cast("string"), F.col("brand"))).join(k, "canonical_product_id", "left")
    alone = F.col("cname").isNull()
    told = lambda ok: F.when(alone | ok, "ok").otherwise("review")
    same_pack = pack(F.col("quantity"), F.coalesce("unit_normalized", "unit")) == pack(F.col("cq"), F.col("cu"))
    return m.select("id", F.coalesce("active_markets", F.lit(0)).alias("active_markets"), "min_price", F.coalesce("offer_count", F.lit(0)).alias("offer_count"), told(normalize(F.col("name")) == normalize(F.col("cname"))).alias("compare_name"), told(same_pack).alias("compare_unit"), F.lit("fix").alias("compare_brand"))


_VALID = f"validation_status = 'validated' AND (valid_from IS NULL OR valid_from <= {_AT}) AND (valid_until IS NULL OR valid_until >= {_AT})"


@query("offer_filters", f"""WITH {cte('offers')} SELECT id, {_VALID} AS valid_now, coalesce(eligibility, 'ALL_CUSTOMERS') = 'ALL_CUSTOMERS' AS open_to_all, validation_status = 'validated' AS tab_active, coalesce(original_price > price, false) AS tab_drop, original_price IS NULL AS tab_novo, validation_status = 'rejected' AS tab_expired,
  contains(lower(name), 'blue') AS found FROM offers WHERE supermarket_id = 3""")
def offer_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests of offer lists and their tabs, on the offers of one market."""
    o = offer_list(frame(spark, sf_dir, "offers").withColumn("supermarket_id", F.col("supermarket_id").cast("string")), supermarket_id="3")
    status, c = F.col("validation_status"), F.col
    tabs = [filters.offer_tab(t, status, c("price"), c("original_price")).alias(f"tab_{t}") for t in ("active", "drop", "novo", "expired")]
    return o.select("id", filters.offer_valid(status, c("valid_from"), c("valid_until"), _as_of()).alias("valid_now"), filters.eligibility_is(c("eligibility"), "ALL_CUSTOMERS").alias("open_to_all"), *tabs, filters.low_contains(" BLUE ", c("name")).alias("found"))


@query("public_offers", f"""WITH {cte('offers')}, {_NORMAL} SELECT id, CASE WHEN club THEN coalesce(original_price, price) ELSE price END AS public_price, CASE WHEN club THEN price END AS member_price, coalesce(club, false) AS requires_membership, CASE WHEN coalesce(eligibility, 'ALL_CUSTOMERS') = 'ALL_CUSTOMERS' THEN 'none' ELSE 'ok' END AS kind,
  CASE WHEN coalesce(eligibility, 'ALL_CUSTOMERS') = 'ALL_CUSTOMERS' THEN 'Todos' WHEN condition_name IS NOT NULL THEN condition_name || ' · no app' WHEN eligibility = 'APP_ONLY' THEN 'Só no app' ELSE eligibility END AS text, price AS cash_price, CASE WHEN n % 2 = 0 THEN 3 END AS installment_count,
  CASE WHEN condition_name IS NOT NULL THEN 'APP_ONLY:' || condition_name || ':no app' WHEN coalesce(eligibility, 'ALL_CUSTOMERS') = 'ALL_CUSTOMERS' THEN '' ELSE eligibility || '::' END AS drafts FROM normal""")
def public_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What everyone sees of an offer: prices, its condition in a line, payment, and the conditions to edit."""
    from pricewell.functions.money import public_payment

    n = resolve.normalize_offers(_offers(spark, sf_dir)).withColumns({"cash_price": F.col("price"), "installment_count": F.when(F.col("n") % 2 == 0, 3), "installment_amount": F.lit(None).cast("double"), "installment_interest_free": F.lit(None).cast("boolean")})
    c = public_condition(F.col("eligibility"), F.col("conditions"), {"APP_ONLY": "Só no app"})
    drafts = F.array_join(F.transform(condition_drafts(F.col("eligibility"), F.col("conditions")), lambda d: F.concat_ws(":", d["type"], d["name"], d["description"])), ";")
    return n.select("id", club_fields(F.col("price"), F.col("original_price"), F.col("requires_membership"), F.col("public_price"), F.col("member_price"), F.col("membership_name")).alias("f"), c.alias("c"), public_payment().alias("p"), drafts.alias("drafts")).select("id", "f.public_price", "f.member_price", "f.requires_membership", "c.kind", "c.text", "p.cash_price", "p.installment_count", "drafts")


@query("page_offers", f"""WITH {cte('offers')}, m AS (SELECT *, CASE WHEN flyer_id IN ('1', '2') THEN NULL WHEN flyer_id = '3' AND page_number = 2 THEN 5 ELSE page_number END AS pg FROM offers), f AS (SELECT *, max(CASE WHEN pg = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY flyer_id) AS own, max(CASE WHEN pg IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY flyer_id) AS bare FROM m)
SELECT flyer_id, id FROM f WHERE CASE WHEN own = 1 THEN coalesce(pg = 2, false) WHEN bare = 1 THEN pg IS NULL ELSE true END""")
def page_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers to show beside page 2 of each flyer, those without a page where it has none."""
    o = frame(spark, sf_dir, "offers")
    o = o.withColumn("page_number", F.when(F.col("flyer_id").isin("1", "2"), F.lit(None)).when((F.col("flyer_id") == "3") & (F.col("page_number") == 2), 5).otherwise(F.col("page_number")))
    return own_page_or_unpaged(o, "flyer_id", F.lit(2)).select("flyer_id", "id")


@query("eligibility_queue", f"WITH {cte('offers')} SELECT id, coalesce(eligibility, 'ALL_CUSTOMERS') AS eligibility, confidence FROM offers WHERE coalesce(confidence, 1) < 0.9 AND eligibility IS NOT NULL ORDER BY coalesce(confidence, 1), id LIMIT 50")
def eligibility_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligibilities to be reviewed, least sure first."""
    from pricewell.functions.parse import eligibility_status

    sure = F.coalesce("confidence", F.lit(1.0))
    o = frame(spark, sf_dir, "offers").filter((eligibility_status(sure) == "review_required") & F.col("eligibility").isNotNull())
    return o.orderBy(sure, "id").limit(50).select("id", "eligibility", "confidence")


@query("offer_scores", f"WITH {cte('offers')} SELECT id, CASE WHEN length(name) >= 3 THEN 20 ELSE 0 END + CASE WHEN price > 0 THEN 20 ELSE 0 END + CASE WHEN brand <> '' THEN 15 ELSE 0 END + CASE WHEN n % 2 = 0 THEN 15 ELSE 0 END + CASE WHEN n % 3 = 0 THEN 10 ELSE 0 END + 10 + 10 AS score FROM offers")
def offer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of raw records for what they tell."""
    c, k = F.col, F.col("n")
    return frame(spark, sf_dir, "offers").select("id", filters.offer_score(c("name"), c("price"), c("brand"), F.when(k % 2 == 0, "x"), F.when(k % 3 == 0, "i"), F.lit("u")).alias("score"))


@query("reanalyzed_pages", f"""WITH {cte('offers')}, b AS (SELECT flyer_id, coalesce(CAST(page_number AS STRING), '?') || '|' || lower(trim(name)) AS k, arg_max(price, n) AS before FROM offers WHERE validation_status <> 'validated' GROUP BY ALL)
SELECT b.flyer_id, o.id, before, {half('o.price * 1.1', 2)} AS after, count(*) FILTER (WHERE v.validation_status = 'validated') AS locked FROM offers o JOIN b ON b.flyer_id = o.flyer_id AND b.k = coalesce(CAST(o.page_number AS STRING), '?') || '|' || lower(trim(o.name)) JOIN offers v ON v.flyer_id = o.flyer_id WHERE before <> {half('o.price * 1.1', 2)} GROUP BY ALL""")
def reanalyzed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices that a second reading of the pages changed, by page and name, with the flyer's locked offers; of earlier doubles the last counts."""
    from pricewell.operators.joins import price_changes

    o = frame(spark, sf_dir, "offers").withColumn("_k", F.concat_ws("|", F.coalesce(F.col("page_number").cast("string"), F.lit("?")), F.lower(F.trim("name"))))
    after = o.select("flyer_id", "_k", "id", half_up(F.col("price") * 1.1, 2).alias("price"))
    found = price_changes(o.filter("validation_status <> 'validated'"), after, ["flyer_id", "_k"], "price", F.col("n"))
    locked = o.groupBy("flyer_id").agg(F.count_if(F.col("validation_status") == "validated").alias("locked"))
    return found.join(locked, "flyer_id").select("flyer_id", "id", F.col("price_before").alias("before"), F.col("price_after").alias("after"), "locked")


@query("offers_page", f"WITH {cte('offers')}, f AS (SELECT * FROM offers WHERE validation_status = 'pending' AND coalesce(eligibility, 'ALL_CUSTOMERS') = 'ALL_CUSTOMERS') SELECT id, supermarket_id, 25 + 25 >= (SELECT count(*) FROM f) AS is_done, CASE WHEN 25 + 25 >= (SELECT count(*) FROM f) THEN '' ELSE '50' END AS continue_cursor, {day('created_at')} AS created FROM (SELECT * FROM f ORDER BY created_at DESC, n DESC LIMIT 25 OFFSET 25)")
def offers_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a filtered list, with the cursor of the next."""
    from pricewell.operators.keyed import numbered_page

    f = offer_list(frame(spark, sf_dir, "offers"), validation_status="pending", eligibility="ALL_CUSTOMERS")
    page = numbered_page(f, [F.desc("created_at"), F.desc("n")], "25", 25)
    return page.select("id", "supermarket_id", "is_done", "continue_cursor", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created"))
