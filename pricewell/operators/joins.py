"""Join shapes: dimension lookup, ranges, scopes, fallbacks, text matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.operators.token_index import keyed_texts, matching_texts, query_key


def lookup(df: DataFrame, dim: DataFrame, on: str, column: str, missing: str = "—") -> DataFrame:
    """A name from a dimension; rows whose key is not there get a dash. Spark broadcasts the side if its size allows."""
    return df.join(dim, on, "left").withColumn(column, F.coalesce(F.col(column), F.lit(missing)))


def nest(parent: DataFrame, child: DataFrame, key: str, columns: list[str], name: str, order: list[str]) -> DataFrame:
    """Each parent with its children as a sorted array of structs (empty if none)."""
    rest = [c for c in columns if c not in order]
    rows = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
    return parent.join(rows, key, "left").withColumn(name, F.coalesce(name, F.array()))


def in_range(intervals: DataFrame, points: DataFrame, on: str, begin: str, end: str, ts: str, bucket_seconds: int) -> DataFrame:
    """Points within closed intervals of the same key.

    Both sides are dealt by key and time bucket, so a key with very many rows is spread over its
    buckets; an interval is repeated for each bucket that it touches.
    """
    to_bucket = lambda c: F.floor(F.unix_timestamp(c) / bucket_seconds)
    left = intervals.withColumn("_b", F.explode(F.sequence(to_bucket(F.col(begin)), to_bucket(F.col(end)))))
    right = points.withColumn("_b", to_bucket(F.col(ts)))
    return left.join(right, [on, "_b"]).filter(F.col(ts).between(F.col(begin), F.col(end))).drop("_b")


def range_marks(intervals: DataFrame, points: DataFrame, key: str, on: str, begin: str, end: str, ts: str, counts: dict[str, Column]) -> DataFrame:
    """Points and both ends of closed intervals as marks of one time line, for ``range_counts``. No row meets another, so both may be streams.

    At one instant beginnings (``_side`` 0) stand before points (1) and ends (2) after them. Intervals that end before they begin hold nothing and go.
    """
    c = F.col
    p = points.filter(c(on).isNotNull() & c(ts).isNotNull()).select(F.lit(None).cast(intervals.schema[key].dataType).alias(key), on, c(ts).alias("_at"), F.lit(1).alias("_side"), *[F.coalesce(x.cast("long"), F.lit(0)).alias(n) for n, x in counts.items()])
    ends = F.explode(F.array(F.struct(c(begin).alias("_at"), F.lit(0).alias("_side")), F.struct(c(end).alias("_at"), F.lit(2).alias("_side")))).alias("_m")
    i = intervals.filter(c(on).isNotNull() & (c(begin) <= c(end))).select(key, on, ends).select(key, on, "_m._at", "_m._side", *[F.lit(0).cast("long").alias(n) for n in counts])
    return p.unionByName(i)


def range_counts(marks: DataFrame, key: str, on: str, counts: list[str], cell_seconds: int = 21_600) -> DataFrame:
    """(key, counts) of each interval of ``range_marks``: what has come up to its end, less what had come before its beginning.

    Running counts stand for pairs of intervals and points, whose number grows with the product of both. They run within cells of time, so a key
    with very many rows is spread over its cells; what came in earlier cells is a table of one row a key and cell.
    """
    marks = marks.withColumn("_cell", F.floor(F.unix_timestamp("_at") / cell_seconds))
    within = Window.partitionBy(on, "_cell").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(on).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = marks.groupBy(on, "_cell").agg(*[F.sum(n).alias(f"_{n}") for n in counts])
    base = cells.select(on, "_cell", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in counts])
    at = marks.select(key, on, "_cell", "_side", *[F.sum(n).over(within).alias(n) for n in counts]).filter("_side <> 1").join(base, [on, "_cell"])
    sign = F.when(F.col("_side") == 2, 1).otherwise(-1)
    return at.groupBy(key).agg(*[F.sum(sign * (F.col(n) + F.col(f"_{n}"))).alias(n) for n in counts])


def applies_to(scope: Column, stores: Column) -> Column:
    """A flyer without stores applies everywhere, else where it shares one."""
    return (F.coalesce(F.size(scope), F.lit(0)) <= 0) | F.coalesce(F.arrays_overlap(scope, stores), F.lit(False))


def semi_or_all(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Only rows whose key is chosen, or all rows if no row is."""
    marked = df.join(chosen.select(key).distinct().withColumn("_c", F.lit(True)), key, "left")
    hit = marked.agg(F.coalesce(F.bool_or("_c"), F.lit(False)).alias("_any"))  # one row
    return marked.crossJoin(F.broadcast(hit)).filter(F.col("_c").isNotNull() | ~F.col("_any")).drop("_c", "_any")


def text_matches(items: DataFrame, offers: DataFrame, query: str, names: list[str]) -> DataFrame:
    """(item, offer) rows of equal ``product`` or ``offer`` ids, or where some name holds all of the item's tokens.

    Texts are found through an index of their words (``token_index``), so ``items`` may be the lists of
    all users. A pair that matches in several ways is one row; items that are equal in all columns are one item.
    """
    asked = items.withColumnsRenamed({"product": "_product", "offer": "_offer"}).withColumn("_key", query_key(F.col(query)))
    told = keyed_texts(offers, names)
    hits = matching_texts(asked.select(F.col("_key").alias("key")).distinct(), told.select(F.col("_text").alias("text")).distinct())
    found = told.join(hits.select(F.col("text").alias("_text"), F.col("key").alias("_key")), "_text").join(asked, "_key")
    columns = [*offers.columns, *[c for c in asked.columns if c != "_key"]]
    found = found.select(*columns)
    if "product" in items.columns:
        found = found.unionByName(offers.join(asked, F.col("product") == F.col("_product")).select(*columns))
    if "offer" in items.columns:
        found = found.unionByName(offers.join(asked, F.col("offer_id") == F.col("_offer")).select(*columns))
    own = [c for c in columns if c not in offers.columns]
    return found.dropDuplicates(["offer_id", *own]).drop("_product", "_offer")


def price_changes(before: DataFrame, after: DataFrame, keys: list[str], price: str, order: Column) -> DataFrame:
    """Keys whose price differs; of repeated keys before, the last in ``order`` counts."""
    old = before.groupBy(*keys).agg(F.max_by(price, order).alias("price_before"))
    return after.withColumnRenamed(price, "price_after").join(old, keys).filter("price_before <> price_after")


def touched_or_filled(runs: DataFrame, flyers: DataFrame, offers: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """(run_id, flyer_id): flyers made or changed in a run's window, or where there are none, those that got offers in it.

    ``runs``: run_id, market, begin, end; ``flyers``: flyer_id, market, created_at, updated_at; ``offers``: flyer_id, market, created_at.

    A pair is told by the first of the flyer's times in the window, the one whose time before lies outside, so no table of pairs is shuffled to
    make them single; only pairs of a run id that stands in several rows are. Which runs have a flyer is counted, not joined.
    """
    r = runs.select("run_id", "market", "begin", "end").withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy("run_id")))
    times = flyers.select("flyer_id", "market", F.explode(F.array("created_at", "updated_at")).alias("at")).filter("at IS NOT NULL")

    def met(left: DataFrame, points: DataFrame) -> DataFrame:
        points = points.withColumn("_before", F.lag("at").over(Window.partitionBy("flyer_id", "market").orderBy("at")))
        first = lambda some: in_range(some, points, "market", "begin", "end", "at", bucket_seconds).filter("_before IS NULL OR _before < begin").select("run_id", "flyer_id")
        return first(left.filter("_rows = 1")).unionByName(first(left.filter("_rows > 1")).distinct())

    some = range_counts(range_marks(r, times, "run_id", "market", "begin", "end", "at", {"n": F.lit(1)}), "run_id", "market", ["n"]).filter("n > 0")
    left = r.join(some, "run_id", "left_anti")
    return met(r, times).unionByName(met(left, offers.select("flyer_id", "market", F.col("created_at").alias("at"))))


def own_page_or_unpaged(offers: DataFrame, key: str, page: Column) -> DataFrame:
    """Offers of a page; where a group has none, its offers without a page; where it has none of these either, all of it."""
    w = Window.partitionBy(key)
    marked = offers.withColumn("_own", F.coalesce(F.col("page_number") == page, F.lit(False))).withColumn("_bare", F.col("page_number").isNull())
    marked = marked.withColumns({"_any_own": F.max("_own").over(w), "_any_bare": F.max("_bare").over(w)})
    return marked.filter(F.when(F.col("_any_own"), F.col("_own")).when(F.col("_any_bare"), F.col("_bare")).otherwise(True)).drop("_own", "_bare", "_any_own", "_any_bare")
