"""Series for charts: down-sampling, candles, projections, shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.functions.semantics import half_up


def _corners(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the corners of the convex hull of points in order of x."""
    if len(x) < 5:
        return np.arange(len(x))
    px, py, keep = x.tolist(), y.tolist(), set()
    for turn in (1.0, -1.0):
        out: list[int] = []
        for k in range(len(px)):
            while len(out) > 1 and turn * ((px[out[-1]] - px[out[-2]]) * (py[k] - py[out[-2]]) - (py[out[-1]] - py[out[-2]]) * (px[k] - px[out[-2]])) < 0:
                out.pop()
            out.append(k)
        keep.update(out)
    return np.array(sorted(keep))


class _Picker:
    """The picks of one series of ``n`` points that come from back to front: one point a bucket, the one that spans most area between the last pick and the next bucket's mean.

    Areas are over places in the series. Of a bucket only the corners of its hull (the largest triangle over a fixed base ends at one) and its sum are
    held, so memory does not follow the length. Of areas that are equal but for rounding the mean's last bit decides, so the order of its additions is fixed:
    one value after the other, the last place first.
    """

    def __init__(self, n: int, most: int):
        self.n, self.most = n, most
        self.all = most >= n or most < 3
        size = 0.0 if self.all else (n - 2) / (most - 2)
        edge = np.floor(np.arange(1, most + 1) * size).astype(np.int64) + 1 if not self.all else np.zeros(0, np.int64)
        # a mean may reach the last point
        self.begin, self.end, self.stop = (e.tolist() for e in (edge[:-2], np.minimum(edge[1:-1], n - 1), np.minimum(edge[1:-1], n)))
        self.first = self.final = 0.0
        self.points = [(np.zeros(0), np.zeros(0)) for _ in self.begin]
        self.sums = [0.0 for _ in self.begin]

    def add(self, low: int, y: np.ndarray) -> None:
        """The points from place ``low`` on, in order of places; they lie right before those that are known."""
        high = low + len(y)
        if high == self.n:
            self.final = float(y[-1])
        if low == 0:
            self.first = float(y[0])
        for b, (begin, end, stop) in enumerate(zip(self.begin, self.end, self.stop, strict=True)):
            if begin >= high or stop <= low:
                continue
            at = max(begin, low)
            own = y[at - low : max(min(end, high), at) - low]
            px, py = (np.concatenate(z) for z in zip((np.arange(at, at + len(own), dtype=float), own), self.points[b], strict=True))
            keep = _corners(px, py)
            self.points[b] = (px[keep], py[keep])
            self.sums[b] = float(np.add.accumulate(np.append(self.sums[b], y[at - low : min(stop, high) - low][::-1]))[-1])

    def picks(self) -> list[int]:
        """Places of all picks, once every point is known."""
        out, last = [0], (0.0, self.first)
        for b, (px, py) in enumerate(self.points):
            if len(px):
                mean = (self.n - 1.0, self.final)
                if b + 1 < len(self.begin) and (count := self.stop[b + 1] - self.begin[b + 1]) > 0:
                    mean = ((self.begin[b + 1] + self.stop[b + 1] - 1) / 2, self.sums[b + 1] / count)
                area = np.abs((last[0] - mean[0]) * (py - last[1]) - (last[0] - px) * (mean[1] - last[1])) * 0.5
                best = int(np.argmax(area))
                last = (float(px[best]), float(py[best]))
            else:
                # an empty bucket picks its first place, which is the last point
                last = (float(self.begin[b]), self.final)
            out.append(int(last[0]))
        return [*out, self.n - 1]


def decimate(df: DataFrame, series: str, order: list[str], y: str, most: int) -> DataFrame:
    """(series, pick, place): the places of at most ``most`` points of each series that keep its shape; a short series keeps all.

    A pick depends on the one before, so each series is read once, from back to front, and picked when its first point is there; rows come sorted from the
    window that numbers them. A value that is unknown counts as its place. The last point may be picked twice.
    """
    back = F.row_number().over(Window.partitionBy(series).orderBy(*[F.col(c).desc() for c in order])).cast("long")
    n = F.count(F.lit(1)).over(Window.partitionBy(series))
    rows = df.select(series, *[c for c in order if c != series], y).select(F.col(series).alias("s"), (n - back).alias("i"), F.col(y).cast("double").alias("y"), n.alias("n"))
    rows = rows.withColumn("y", F.coalesce("y", F.col("i").cast("double")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picker = None
        for b in batches:
            i, ys, n = (b.column(c).to_numpy() for c in ("i", "y", "n"))
            begin = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1] - 1))) if len(i) else np.zeros(0, np.int64)
            took, places, numbers = [], [], []
            for a, e in zip(begin.tolist(), np.append(begin[1:], len(i)).tolist(), strict=True):
                if i[a] == n[a] - 1:
                    picker = _Picker(int(n[a]), most)
                if picker.all:
                    found = numbered = i[a:e].tolist()
                else:
                    picker.add(int(i[e - 1]), ys[a:e][::-1])
                    found = picker.picks() if i[e - 1] == 0 else []
                    numbered = range(len(found))
                took += [a] * len(found)
                places += found
                numbers += numbered
            if took:
                yield pa.RecordBatch.from_arrays([b.column("s").take(pa.array(took)), pa.array(numbers, pa.int64()), pa.array(places, pa.int64())], [series, "pick", "place"])

    kind = df.schema[series].dataType.simpleString()
    return rows.mapInArrow(run, f"`{series}` {kind}, pick long, place long")


def ohlc(df: DataFrame, series: str, order: list[str], most: int) -> DataFrame:
    """At most ``most`` candles of each series of candles (open, high, low, close): first, highest, lowest and last of equal stretches."""
    w = Window.partitionBy(series)
    marked = df.withColumn("_k", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    size = F.col("_n") / F.lit(float(most))
    guess = F.floor(F.col("_k") / size)
    at = F.when(F.col("_k") >= F.floor((guess + 1) * size), guess + 1).when(F.col("_k") < F.floor(guess * size), guess - 1).otherwise(guess)
    marked = marked.withColumn("bucket", F.when((F.lit(most) >= F.col("_n")) | F.lit(most < 2), F.col("_k")).otherwise(at).cast("long"))
    return marked.groupBy(series, "bucket").agg(F.min_by("open", "_k").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "_k").alias("close"))


def slope(y: Column, x: Column) -> Column:
    """Least squares; 0 with fewer than two points or without spread."""
    return F.coalesce(F.when(F.regr_sxx(y, x) > 1e-12, F.regr_slope(y, x)), F.lit(0.0))


def project(df: DataFrame, series: str, x: str, y: str, steps: int = 6, method: str = "regression", path: str = "stepped", interval: float = 1.0, target: float | None = None) -> DataFrame:
    """(series, x, projected): from the last point on, ``steps`` intervals along a slope, or straight to ``target``.

    ``method``: slope of the regression or of the last segment (``last``). ``path``: every step, or the ``endpoints`` with the last point.
    """
    near = F.max_by(F.struct(x, y), x)
    fit = df.filter(F.col(y).isNotNull()).groupBy(series).agg(slope(F.col(y), F.col(x)).alias("_s"), near.alias("_p"), F.array_sort(F.collect_list(F.struct(x, y))).alias("_all"))
    if method == "last":
        a, b = F.get("_all", F.size("_all") - 2), F.get("_all", F.size("_all") - 1)
        fit = fit.withColumn("_s", F.coalesce((b[y] - a[y]) / F.nullif(b[x] - a[x], F.lit(0)), F.lit(0.0)))
    far = F.array(F.lit(0), F.lit(steps)) if path == "endpoints" or target is not None else F.sequence(F.lit(1), F.lit(steps))
    ahead = fit.select(series, F.explode(far).alias("_k"), "_s", F.col("_p")[x].alias("_x"), F.col("_p")[y].alias("_y"))
    value = F.col("_y") + F.col("_s") * F.col("_k") * interval
    if target is not None:
        value = F.when(F.col("_k") == 0, F.col("_y")).otherwise(F.lit(float(target)))
    return ahead.select(series, (F.col("_x") + F.col("_k") * interval).cast("double").alias(x), half_up(value, 4).alias("projected"))


def anchor_slope(df: DataFrame, series: str, x: str, y: str, until: Column | None = None) -> DataFrame:
    """(series, slope): of the last two known points up to ``until``; 0 with fewer or without a step between them."""
    known = df.filter(F.col(y).isNotNull() & (F.lit(True) if until is None else F.col(x) <= until))
    w = Window.partitionBy(series).orderBy(F.desc(x))
    two = known.withColumn("_n", F.row_number().over(w)).filter("_n <= 2").groupBy(series).agg(*[F.max(F.when(F.col("_n") == n, F.col(c))).alias(f"_{c}{n}") for c in (x, y) for n in (1, 2)])
    return two.select(series, F.coalesce((F.col(f"_{y}1") - F.col(f"_{y}2")) / F.nullif(F.col(f"_{x}1") - F.col(f"_{x}2"), F.lit(0)), F.lit(0.0)).alias("slope"))


def stack(df: DataFrame, row: str, series: str, value: str) -> DataFrame:
    """Where each bar of a stack begins, and its share of the row."""
    w = Window.partitionBy(row)
    base = F.coalesce(F.sum(value).over(w.orderBy(series).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn("base", half_up(base, 4)).withColumn("share", half_up(F.col(value) / F.sum(value).over(w), 6))


def tallest(df: DataFrame, columns: list[str]) -> DataFrame:
    """The greatest sum of the columns over all rows: how high a stacked chart must be."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return df.agg(F.max(total).alias("tallest"))


def extent(df: DataFrame, column: str, pad: float = 0.05, reach: float | None = None) -> DataFrame:
    """Least and greatest value (at least ``reach``), a domain with some room on both sides, and one from zero with a tenth above."""
    top = F.max(column) if reach is None else F.greatest(F.max(column), F.lit(reach))
    e = df.agg(F.min(column).alias("low"), top.alias("high"))
    room = F.coalesce(F.nullif((F.col("high") - F.col("low")) * pad, F.lit(0.0)), F.lit(1.0))
    zero = F.col("low") >= 0
    return e.withColumns({
        "domain_low": F.col("low") - room, "domain_high": F.col("high") + room,
        "axis_low": F.when(zero, F.lit(0.0)).otherwise(F.col("low") - room), "axis_high": F.when(zero, F.when(F.col("high") <= 0, F.lit(100.0)).otherwise(F.col("high") * 1.1)).otherwise(F.col("high") + room),
    })


def axis_domains(df: DataFrame, axis: str, columns: list[str]) -> DataFrame:
    """(axis, low, high) over all value columns of the series on each axis."""
    return df.groupBy(axis).agg(F.min(F.least(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])).alias("low"), F.max(F.greatest(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])).alias("high"))
