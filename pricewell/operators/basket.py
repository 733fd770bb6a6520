"""A shopping list across markets: best offers, one-store baskets, a two-store split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewell.functions.semantics import half_up
from pricewell.operators.token_index import keyed_texts, matching_texts, query_key
from pricewell.sources.scratch import kept


def best_offers(items: DataFrame, offers: DataFrame, names: tuple[str, ...] = ("name",), keys: tuple[str, ...] = ("item",), with_offer: bool = True) -> DataFrame:
    """(keys, market, offer_id, line_total): the cheapest matching offer of each item and market.

    ``items``: the keys, query, quantity, product and offer (null: only the text counts); ``offers``: offer_id, market, product, ranking_price and
    the ``names``. An item takes the least of three: the cheapest offer of a matching text, that of its product, and the offer it names.
    Offers are reduced to one for each text (or product) and market before anything is joined, and equal queries are answered once, so the lists of all users are one job.
    Without ``with_offer`` only the price is kept, a number that Spark aggregates in place: a struct with a text has all rows sorted first.
    """
    told = F.struct("ranking_price", "offer_id") if with_offer else F.col("ranking_price")
    cheapest = lambda df, *by: df.groupBy(*by, "market").agg(F.min(told).alias("_best"))
    # queries without a token find nothing; left in, all of them would meet in the task of one key
    asked = items.withColumn("_key", query_key(F.col("query"))).filter("_key <> ''")
    by_text = kept(cheapest(keyed_texts(offers, list(names)), "_text"), "offers-by-text")
    hits = matching_texts(asked.select(F.col("_key").alias("key")).distinct(), by_text.select(F.col("_text").alias("text")).distinct())
    by_key = hits.select(F.col("text").alias("_text"), F.col("key").alias("_key")).join(by_text, "_text").groupBy("_key", "market").agg(F.min("_best").alias("_best"))
    own = [*keys, "quantity", "market", "_best"]
    met = asked.join(by_key, "_key").select(*own)
    if "product" in items.columns:
        met = met.unionByName(items.join(cheapest(offers, "product"), "product").select(*own))
    if "offer" in items.columns:
        met = met.unionByName(items.join(offers.select(F.col("offer_id").alias("offer"), "market", told.alias("_best")), "offer").select(*own))
    best = met.groupBy(*keys, "market").agg(F.min("_best").alias("_best"), F.first("quantity").alias("quantity"))
    if not with_offer:
        return best.select(*keys, "market", (F.col("_best") * F.col("quantity")).alias("line_total"))
    return best.select(*keys, "market", F.col("_best.offer_id").alias("offer_id"), (F.col("_best.ranking_price") * F.col("quantity")).alias("line_total"))


def baskets(best: DataFrame, n_items: int, markets: DataFrame) -> DataFrame:
    """Per market (those without any match too): total, missing items, coverage and whether it is complete."""
    b = best.groupBy("market").agg(F.sum("line_total").alias("total"), F.count(F.lit(1)).alias("found"))
    all_ = markets.select("market").distinct().join(b, "market", "left").fillna(0, ["total", "found"])
    return all_.select("market", half_up(F.col("total"), 2).alias("total"), (F.lit(n_items) - F.col("found")).alias("missing"), half_up(F.col("found") / n_items * 100, 1).alias("coverage_pct"), (F.col("found") == n_items).alias("complete"))


def list_baskets(items: DataFrame, offers: DataFrame, names: tuple[str, ...] = ("name",)) -> DataFrame:
    """(list_id, market, total, missing, complete) of all lists at every market that has something of them."""
    sizes = items.groupBy("list_id").agg(F.count(F.lit(1)).alias("_n"))
    b = best_offers(items, offers, names, ("list_id", "item"), with_offer=False).groupBy("list_id", "market").agg(F.sum("line_total").alias("total"), F.count(F.lit(1)).alias("_found"))
    return b.join(sizes, "list_id").select("list_id", "market", half_up(F.col("total"), 2).alias("total"), (F.col("_n") - F.col("_found")).alias("missing"), (F.col("_n") == F.col("_found")).alias("complete"))


def ranked(per_market: DataFrame) -> DataFrame:
    """The complete markets, or all if none is: fewest missing, then cheapest."""
    some = per_market.agg(F.coalesce(F.bool_or("complete"), F.lit(False)).alias("_some"))  # one row
    return per_market.crossJoin(F.broadcast(some)).filter(F.col("complete") | ~F.col("_some")).drop("_some").orderBy("missing", "total", "market")


def best_single(per_market: DataFrame) -> DataFrame:
    """The first of ``ranked``, and what it saves against the dearest complete market (0 if it is not complete itself)."""
    dearest = per_market.agg(F.max(F.when(F.col("complete"), F.col("total"))).alias("_dearest"))
    top = ranked(per_market).limit(1).crossJoin(F.broadcast(dearest))
    return top.select("market", "total", "missing", "complete", F.when(F.col("complete"), F.greatest(F.lit(0.0), half_up(F.col("_dearest") - F.col("total"), 2))).otherwise(F.lit(0.0)).alias("savings_vs_worst"))


def split_two(best: DataFrame, n_items: int) -> DataFrame:
    """(item, market, line_total): every item at its cheapest market, at most two markets in all; nothing if some item is nowhere.

    Of more than two markets the two with most items stay (of equals the one whose first item comes first) and the others' items
    move to the cheaper of them; an item that neither has is left out.
    """
    cheapest = best.groupBy("item").agg(F.min_by("market", F.struct("line_total", "market")).alias("market"))
    whole = cheapest.agg((F.count(F.lit(1)) == n_items).alias("_whole"))
    kept = cheapest.groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("first")).orderBy(F.desc("n"), "first").limit(2)
    kept = kept.select("market", F.row_number().over(Window.orderBy(F.desc("n"), "first")).alias("_r"))  # two rows
    own = best.join(F.broadcast(kept), "market").join(cheapest.withColumnRenamed("market", "_own"), "item").crossJoin(F.broadcast(whole)).filter("_whole")
    # an item whose cheapest market stays keeps it, others take the cheaper of the two
    order = F.struct(F.col("market") != F.col("_own"), "line_total", "_r")
    return own.groupBy("item").agg(F.min_by(F.struct("market", "line_total"), order).alias("r")).select("item", "r.market", half_up(F.col("r.line_total"), 2).alias("line_total"))


def split_summary(split: DataFrame, single: DataFrame) -> DataFrame:
    """One row: stores, lines and total of the split, and what it saves against the best single market if that is complete."""
    s = split.agg(F.count_distinct("market").alias("stores"), F.count(F.lit(1)).alias("lines"), half_up(F.sum("line_total"), 2).alias("split_total")).filter("stores > 0")
    one = single.select(F.col("total").alias("_t"), F.col("complete").alias("_c"))
    return s.crossJoin(F.broadcast(one)).select("stores", "lines", "split_total", F.when(F.col("_c") & (F.col("_t") > F.col("split_total")), half_up(F.col("_t") - F.col("split_total"), 2)).otherwise(F.lit(0.0)).alias("savings_vs_best_single"))


def lines(best: DataFrame, items: DataFrame, markets: DataFrame) -> DataFrame:
    """Every item at every market, with its offer or none: a grid of the list's length times the number of markets."""
    grid = markets.select("market").distinct().crossJoin(F.broadcast(items.select("item", "quantity")))
    return grid.join(best, ["item", "market"], "left").withColumn("missing", F.col("offer_id").isNull())
