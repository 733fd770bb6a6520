"""One row for each key, forward fill, as-of lookups and other windowed shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.operators.grouped import replay
from pricewell.sources.scratch import kept


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key. A row number limit is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def arg_first(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Like ``first_by`` with n=1, but as an aggregation that combines before its shuffle.

    ``order`` is ascending; negate numbers to descend.
    """
    best = F.min_by(F.struct(*columns), F.struct(*[o.alias(f"o{n}") for n, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in columns])


def last_before(df: DataFrame, keys: list[str], ts: str, at: Column, tie: str, value: str, name: str) -> DataFrame:
    """The latest value strictly before an instant, for each key."""
    return df.filter(F.col(ts) < at).groupBy(*keys).agg(F.max_by(value, F.struct(ts, tie)).alias(name))


def forward_fill(df: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """Nulls of ``column`` become the last value before them within the key."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def top_groups(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, n, rank) of the ``k`` most frequent values; ties by value."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k)
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc(key))).cast("int"))


def neighbours(df: DataFrame, order: list[Column], key: str) -> DataFrame:
    """``prev`` and ``next`` of each row in a bounded queue, wrapping around; null when it is alone."""
    w = Window.orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead(key).over(w), F.first(key).over(whole))
    before = F.coalesce(F.lag(key).over(w), F.last(key).over(whole))
    return df.withColumn("next", F.when(after != F.col(key), after)).withColumn("prev", F.when(before != F.col(key), before))


def nearest_point(points: DataFrame, x: str, at: DataFrame, to: str, ranges: int = 64) -> DataFrame:
    """Each ``to`` of ``at`` with the nearest ``x``; of two equally near the left one.

    Equal values are answered once. Quantiles cut the distinct values of both sides into ranges of about equal size; within a range two running windows
    find the neighbours, and what lies beyond its ends comes from a table of the ranges' first and last points, which is as small as their number.
    """
    p, q = points.select(F.col(x).cast("double").alias("_v")).filter("_v IS NOT NULL"), at.select(F.col(to).cast("double").alias("_v")).filter("_v IS NOT NULL")
    values = p.withColumn("_point", F.lit(True)).unionByName(q.withColumn("_point", F.lit(False))).groupBy("_v").agg(F.max("_point").alias("_point"), F.min("_point").alias("_alone"))
    cuts = values.agg(F.percentile_approx("_v", [k / ranges for k in range(1, ranges)], 10_000).alias("_cuts"))  # one row
    both = values.crossJoin(F.broadcast(cuts)).select("_v", F.when(F.col("_point"), F.col("_v")).alias("_x"), (~F.col("_alone")).alias("_asked"), F.size(F.filter("_cuts", lambda e: e < F.col("_v"))).alias("_r"))
    ends = both.groupBy("_r").agg(F.min("_x").alias("_first"), F.max("_x").alias("_last"))
    w = Window.orderBy("_r")  # as many rows as ranges
    around = ends.select("_r", F.max("_last").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_first").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    # both frames grow row by row: one that shrinks towards its end is worked out anew for every row
    upto = lambda order: F.last("_x", ignorenulls=True).over(Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    near = both.withColumns({"_l": upto(F.asc("_v")), "_n": upto(F.desc("_v"))}).filter("_asked").join(F.broadcast(around), "_r")
    near = near.select("_v", F.coalesce("_l", "_before").alias("_l"), F.coalesce("_n", "_after").alias("_n"))
    near = near.select("_v", F.when(F.col("_n").isNull() | (F.col("_v") - F.col("_l") <= F.col("_n") - F.col("_v")), F.col("_l")).otherwise(F.col("_n")).alias("nearest"))
    return q.join(near, "_v").select(F.col("_v").alias(to), "nearest")


def unique_row(df: DataFrame, what: str = "row") -> DataFrame:
    """``df`` if it has one row or none; more are an error when it is read."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    ok = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"more than one {what}: "), F.col("_n").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return df.crossJoin(F.broadcast(n)).filter(ok).drop("_n")


def numbered_page(df: DataFrame, order: list[Column], cursor: str | None, size: int) -> DataFrame:
    """A page from a cursor (the number of rows before it, as text), with ``is_done`` and ``continue_cursor`` on each row."""
    begin = int(cursor) if cursor and cursor.isdigit() else 0
    page = df.orderBy(*order).offset(begin).limit(size)
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    done = F.lit(begin + size) >= F.col("_n")
    return page.crossJoin(F.broadcast(n)).withColumns({"is_done": done, "continue_cursor": F.when(done, F.lit("")).otherwise(F.lit(str(begin + size)))}).drop("_n")


def strip_around(queue: DataFrame, order: str, current, size: int = 4) -> DataFrame:
    """``size`` items of a queue from the one before ``current`` on; nothing if it is not there."""
    at = queue.withColumn("_n", F.row_number().over(Window.orderBy(order)))
    here = at.filter(F.col(order) == F.lit(current)).select(F.greatest(F.col("_n") - 1, F.lit(1)).alias("_b"))
    return at.crossJoin(F.broadcast(here)).filter((F.col("_n") >= F.col("_b")) & (F.col("_n") < F.col("_b") + size)).drop("_n", "_b")


def offset_page(df: DataFrame, order: list[Column], page: int, size: int = 25) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def keyset_page(df: DataFrame, key: str, after, size: int = 25) -> DataFrame:
    """The next page after a key: reads no more rows than it returns, however deep the page."""
    return (df if after is None else df.filter(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def last_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    return min(max(default if value is None else value, low), high)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for rows (node, key): nodes that share a key, directly or through others, get one label, the smallest of them.

    Labels go from nodes to keys and back, and then to the label of the label, until a round changes none. Both ways are minima that combine before
    their shuffle, so a key that very many nodes share is one row for each task. Every round is a table, which ends its lineage.
    """
    edges = kept(edges.select("node", "key").distinct(), "edges")
    label = edges.select("node", F.col("node").alias("label")).distinct()
    while True:
        by_key = edges.join(label, "node").groupBy("key").agg(F.min("label").alias("label"))
        new = edges.join(by_key, "key").groupBy("node").agg(F.min("label").alias("label"))
        far = new.select(F.col("node").alias("label"), F.col("label").alias("_far"))
        new = new.join(far, "label", "left").select("node", F.least("label", "_far").alias("label"))
        new = kept(new.join(label.withColumnRenamed("label", "_old"), "node"), "labels")
        changed = new.filter("label <> _old").limit(1).count()
        label = new.select("node", "label")
        if not changed:
            return label


NUMBERED = r"^(.*)-([1-9][0-9]{0,17})$"


def unique_slugs(rows: DataFrame, base: str, order: list[str], taken: DataFrame | None = None, scope: tuple[str, ...] = ()) -> DataFrame:
    """``slug`` of each row: its base, or ``base-1``, ``base-2`` and so on, the first that is free when its turn in ``order`` comes.

    ``taken`` (scope, slug) are slugs in use already. Within a scope, only slugs of one root (a base without numbers at its end) can meet. Where a root has a single base, the
    row of rank r takes the r-th number that is not taken: two windows, whatever their number. Where there are several, as in ``a b`` and ``a b 1``, a row
    may be beaten by one of another base; these roots' rows take their turns one by one, a root a group.
    """
    scope_ = list(scope)
    root = lambda c: F.regexp_replace(c, r"(-[1-9][0-9]{0,17})+$", "")
    keyed = rows.withColumn("_root", root(F.col(base)))
    used = (taken.select(*scope_, "slug") if taken is not None else rows.select(*scope_, F.col(base).alias("slug")).limit(0)).distinct().withColumn("_root", root(F.col("slug")))
    several = keyed.groupBy(*scope_, "_root").agg((F.min(base) != F.max(base)).alias("_several"))
    keyed = keyed.join(several, [*scope_, "_root"])

    alone = keyed.filter("NOT _several").drop("_several", "_root").withColumn("_r", F.row_number().over(Window.partitionBy(*scope_, base).orderBy(*order)) - 1)
    bases = alone.select(*scope_, base).distinct()
    forms = used.select(*scope_, F.col("slug").alias(base), F.lit(0).cast("long").alias("_k")).unionByName(used.filter(F.col("slug").rlike(NUMBERED)).select(*scope_, F.regexp_extract("slug", NUMBERED, 1).alias(base), F.regexp_extract("slug", NUMBERED, 2).cast("long").alias("_k")))
    forms = forms.join(bases, [*scope_, base], "left_semi").withColumn("_r", F.col("_k") - F.row_number().over(Window.partitionBy(*scope_, base).orderBy("_k")) + 1)
    both = alone.withColumn("_form", F.lit(0)).unionByName(forms.select(*scope_, base, F.col("_r").cast("int").alias("_r"), F.lit(1).alias("_form")), allowMissingColumns=True)
    skipped = F.sum("_form").over(Window.partitionBy(*scope_, base).orderBy("_r", F.desc("_form")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    n = F.col("_r") + F.col("_skipped")
    settled = both.withColumn("_skipped", skipped).filter("_form = 0").select(*rows.columns, F.when(n == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string"))).alias("slug"))

    def turns(group: list[dict]) -> list[dict]:
        gone, following, out = {r["_slug"] for r in group if r["_taken"]}, {}, []
        for r in group:
            if r["_taken"]:
                continue
            b = r[base]
            k = following.get(b, 0)
            while (s := b if k == 0 else f"{b}-{k}") in gone:
                k += 1
            gone.add(s)
            following[b] = k + 1
            out.append({**r, "slug": s})
        return out

    mixed = keyed.filter("_several").drop("_several").withColumn("_taken", F.lit(False))
    theirs = used.join(several.filter("_several"), [*scope_, "_root"], "left_semi").withColumnRenamed("slug", "_slug").withColumn("_taken", F.lit(True))
    met = mixed.unionByName(theirs, allowMissingColumns=True)
    met = replay(met, [*scope_, "_root"], order, turns, T.StructType([*rows.schema.fields, T.StructField("slug", T.StringType())]))
    return settled.unionByName(met)
