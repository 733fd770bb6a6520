"""Offers to brands and canonical products; merges and fixes. All are frames in, frames out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.functions.semantics import number_of
from pricewell.functions.text import fold, match_key, normalize, normalize_unit, slug, title_case
from pricewell.operators.filters import validation_status


def normalize_offers(offers: DataFrame, members: bool = True) -> DataFrame:
    """Normalised name, brand, quantity and unit; with ``members`` also public and members' prices."""
    c = F.col
    out = offers.withColumns({
        "normalized_name": normalize(c("name")),
        "normalized_brand": F.when(c("brand").isNotNull() & (c("brand") != ""), title_case(c("brand"))),
        "quantity_value": F.when(c("quantity").isNotNull() & (c("quantity") != ""), number_of(c("quantity"))),
        "unit_normalized": normalize_unit(c("unit")),
    })
    if not members:
        return out
    club = c("eligibility").isNotNull() & (c("eligibility") != "ALL_CUSTOMERS")
    return out.withColumns({
        "requires_membership": club,
        "member_price": F.when(club, c("price")),
        "public_price": F.when(club, F.coalesce(c("original_price"), c("price"))).otherwise(c("price")),
        "membership_name": F.when(club, F.coalesce(F.get(c("conditions.name"), F.lit(0)), c("eligibility"))),
    })


def ensure_brands(offers: DataFrame, brands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(offers with brand_id, new brand rows): by slug, else by alias, else a new brand with an id from its slug.

    An alias counts if it is the brand's name but for case and accents; signs and blanks differ. Offers whose names have one slug are one new brand.
    """
    plain = lambda x: fold(F.lower(x))
    own = offers.withColumns({"_slug": slug(F.col("normalized_brand")), "_plain": plain(F.col("normalized_brand"))})
    by_slug = brands.groupBy(F.col("slug").alias("_slug")).agg(F.min("id").alias("_a"))  # one brand a slug, so no offer comes twice
    by_alias = brands.select(F.explode("aliases").alias("_x"), F.col("id").alias("_b")).groupBy(plain(F.col("_x")).alias("_plain")).agg(F.min("_b").alias("_b"))
    met = own.join(by_slug, "_slug", "left").join(by_alias, "_plain", "left")
    made = F.when(F.col("_slug") != "", F.sha2(F.col("_slug"), 256))
    known = F.coalesce("_a", "_b")
    new = met.filter(known.isNull() & made.isNotNull()).groupBy("_slug").agg(F.min("normalized_brand").alias("name"))
    new = new.select(F.sha2("_slug", 256).alias("id"), "name", F.col("_slug").alias("slug"), F.array().cast("array<string>").alias("aliases"))
    return met.withColumn("brand_id", F.coalesce(known, made)).drop("_slug", "_plain", "_a", "_b"), new


def resolve_products(offers: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(offers with canonical_product_id, new products): by match key; the first offer (by id) supplies a new product."""
    keyed = offers.withColumn("match_key", match_key(F.col("name"), F.col("normalized_brand"), F.col("quantity"), F.col("unit")))
    known = products.groupBy("match_key").agg(F.min_by("id", F.struct("created_at", "id")).alias("_p"))
    met = keyed.join(known, "match_key", "left")
    first = met.filter("_p IS NULL").groupBy("match_key").agg(F.min_by(F.struct("name", "brand_id", "quantity", "unit_normalized", "created_at"), "id").alias("r"))
    new = first.select(F.sha2("match_key", 256).alias("id"), F.col("r.name").alias("canonical_name"), slug(F.col("r.name")).alias("slug"), "r.brand_id", "r.quantity", F.col("r.unit_normalized").alias("unit"), "match_key", F.col("r.created_at").alias("created_at"), F.col("r.created_at").alias("updated_at"))
    return met.withColumn("canonical_product_id", F.coalesce("_p", F.sha2("match_key", 256))).drop("_p", "match_key"), new


def new_price_rows(offers: DataFrame, history: DataFrame) -> DataFrame:
    """A price row for each offer that has none."""
    return offers.join(history.select(F.col("offer_id").alias("id")).distinct(), "id", "left_anti").select(F.sha2("id", 256).alias("id"), "canonical_product_id", "supermarket_id", F.col("id").alias("offer_id"), "price", "original_price", "member_price", "requires_membership", F.when(F.col("requires_membership"), F.col("eligibility")).alias("membership_name"), "valid_from", "valid_until", "created_at")


def merge_brand(offers: DataFrame, products: DataFrame, brands: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Offers and products move to the target brand, which takes over name and aliases; the source goes."""
    move = lambda df: df.withColumn("brand_id", F.when(F.col("brand_id") == source, F.lit(target)).otherwise(F.col("brand_id")))
    taken = brands.filter(F.col("id") == source).select(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("_more"))
    left = brands.filter(F.col("id") != source).join(F.broadcast(taken), F.lit(True), "left")  # one row
    left = left.withColumn("aliases", F.when(F.col("id") == target, F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>")))).otherwise(F.col("aliases"))).drop("_more")
    return move(offers), move(products), left


def merge_product(offers: DataFrame, history: DataFrame, products: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Offers and prices move to the target product; offers without a brand take over the target's. The source goes."""
    here = F.coalesce(F.col("canonical_product_id") == source, F.lit(False))
    move = lambda df: df.withColumn("canonical_product_id", F.when(here, F.lit(target)).otherwise(F.col("canonical_product_id")))
    own = products.filter(F.col("id") == target).agg(F.first("brand_id").alias("_brand"))  # one row
    told = offers.crossJoin(F.broadcast(own)).withColumn("brand_id", F.when(here, F.coalesce("brand_id", "_brand")).otherwise(F.col("brand_id"))).drop("_brand")
    return move(told), move(history), products.filter(F.col("id") != source)


def unlink_offer(offers: DataFrame, history: DataFrame, offer_id: str) -> tuple[DataFrame, DataFrame]:
    cleared = F.when(F.col("id") == offer_id, F.lit(None).cast("string")).otherwise(F.col("canonical_product_id"))
    return offers.withColumn("canonical_product_id", cleared), history.filter(F.col("offer_id") != offer_id)


def set_eligibility(offers: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(offers, audit rows) for changes (id, eligibility, confidence, source)."""
    c = changes.select("id", F.col("eligibility").alias("_e"), F.col("confidence").alias("_c"), F.col("source").alias("_s"))
    met = offers.join(c, "id", "left")
    audit = met.filter("_e IS NOT NULL").select(F.col("id").alias("offer_id"), F.col("eligibility").alias("previous"), F.col("_e").alias("new"), F.col("eligibility_confidence").alias("previous_confidence"), F.col("_c").alias("new_confidence"), F.col("_s").alias("source"))
    return met.withColumns({"eligibility": F.coalesce("_e", "eligibility"), "eligibility_confidence": F.coalesce("_c", "eligibility_confidence")}).drop("_e", "_c", "_s"), audit


def apply_fix(offers: DataFrame, products: DataFrame, fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(offers, products) after fixes (id of the offer, brand_id, quantity, unit); null leaves a field as it is.

    A fixed offer's product takes over what it lacks.
    """
    c = fixes.select("id", F.col("brand_id").alias("_b"), F.col("quantity").alias("_q"), F.col("unit").alias("_u"))
    met = offers.join(c, "id", "left").withColumns({"brand_id": F.coalesce("_b", "brand_id"), "quantity": F.coalesce("_q", "quantity"), "unit": F.coalesce("_u", "unit")})
    met = met.withColumns({"quantity_value": F.when(F.col("_q").isNotNull(), number_of(F.col("_q"))).otherwise(F.col("quantity_value")), "unit_normalized": F.when(F.col("_u").isNotNull(), normalize_unit(F.col("_u"))).otherwise(F.col("unit_normalized"))})
    told = met.filter("_b IS NOT NULL OR _q IS NOT NULL OR _u IS NOT NULL").groupBy(F.col("canonical_product_id").alias("id")).agg(F.min("_b").alias("_b"), F.min("_q").alias("_q"), F.min(normalize_unit(F.col("_u"))).alias("_u"))
    p = products.join(told, "id", "left").withColumns({"brand_id": F.coalesce("brand_id", "_b"), "quantity": F.coalesce("quantity", "_q"), "unit": F.coalesce("unit", "_u")}).drop("_b", "_q", "_u")
    return met.drop("_b", "_q", "_u"), p


def process_offers(offers: DataFrame, brands: DataFrame, products: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(offers, new brands, new products, new price rows): normalise, resolve brand and product, price, and judge the pending ones."""
    known, new_brands = ensure_brands(normalize_offers(offers), brands)
    resolved, new_products = resolve_products(known, products)
    return validate_pending(resolved), new_brands, new_products, new_price_rows(resolved, history)


def validate_pending(offers: DataFrame) -> DataFrame:
    """Only pending offers get a verdict, by their normalised name where they have one."""
    verdict = validation_status(F.coalesce("normalized_name", "name"), F.col("price"), F.col("confidence"))
    return offers.withColumn("validation_status", F.when(F.col("validation_status") == "pending", verdict).otherwise(F.col("validation_status")))


def next_in_queue(queue: DataFrame, after: str, order: str = "id") -> DataFrame:
    """(pending, next): the length of a queue, and what follows an item in it, from the front again at its end; null if that is the item itself."""
    follows = F.min(F.when(F.col(order) > F.lit(after), F.col(order)))
    return queue.agg(F.count(F.lit(1)).alias("pending"), F.coalesce(follows, F.min(order)).alias("next")).withColumn("next", F.when(F.col("next") != F.lit(after), F.col("next")))
