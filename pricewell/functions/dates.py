"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def calendar(spark: SparkSession, first: str, days: int) -> DataFrame:
    """(day) for so many days from ``first``."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.date_add(F.to_date(F.lit(first)), days - 1))).alias("day"))


def sunday_week(d: Column) -> Column:
    """The Sunday on or before a date."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def days_until(as_of: Column, until: Column, zone: str) -> Column:
    """Calendar days between two instants in a time zone."""
    return F.datediff(F.to_date(F.from_utc_timestamp(until, zone)), F.to_date(F.from_utc_timestamp(as_of, zone)))


def year_start(d: Column) -> Column:
    """First day of the month eleven months back."""
    return F.trunc(F.add_months(d, -11), "MM")


def quarter_start(d: Column) -> Column:
    return F.trunc(d, "QUARTER")


def heat_level(n: Column) -> Column:
    """0, 1, 2, 3, 4 and more."""
    return F.greatest(F.least(n, F.lit(4)), F.lit(0)).cast("int")


def backoff_hours(attempt: Column, most: float = 8.0) -> Column:
    return F.least(F.lit(most), F.pow(F.lit(2.0), attempt - 1))


def parse_validity(x: Column, as_of: Column, zone: str = "America/Fortaleza", until: bool = False) -> Column:
    """An instant from epoch seconds or milliseconds, ISO text, or dd/MM[/yy[yy]].

    A date alone begins, or with ``until`` ends, its day in the zone. A missing year is that of ``as_of``.
    """
    t = F.trim(x)
    number = t.try_cast("double")
    epoch = F.when(t.rlike(r"^\d{9,14}$"), F.timestamp_millis(F.when(number < 1e11, number * 1000).otherwise(number).cast("long")))
    offset = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T.*(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(t))
    d, m, y = (F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?$", k) for k in (1, 2, 3))
    year = F.when(y == "", F.year(F.from_utc_timestamp(as_of, zone)).cast("string")).when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    brazil = F.when(d != "", F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))
    date = F.coalesce(brazil, F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t))
    clock = " 23:59:59" if until else " 00:00:00"
    local = F.coalesce(F.try_to_timestamp(F.concat(date, F.lit(clock))), F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?$"), F.try_to_timestamp(F.replace(t, F.lit("T"), F.lit(" ")))))
    return F.coalesce(epoch, offset, F.to_utc_timestamp(local, zone))


def week_count(first: Column, last: Column) -> Column:
    """Sunday weeks from a Sunday to the week of a day."""
    return (F.floor(F.datediff(sunday_week(last), first) / 7) + 1).cast("int")


def week_column(first: Column, day: Column, weeks: Column) -> Column:
    """The column of a day in a grid of so many Sunday weeks; null beyond it."""
    k = F.floor(F.datediff(day, first) / 7).cast("int")
    return F.when((k >= 0) & (k < weeks), k)


def week_overlaps(week: Column, a: Column, b: Column) -> Column:
    """Whether the week that begins on a Sunday shares a day with a range given in either order."""
    return (F.date_add(week, 6) >= F.least(a, b)) & (week <= F.greatest(a, b))


def rotate(items: Column, by: int) -> Column:
    """An array that begins with its item ``by``."""
    return F.concat(F.slice(items, by + 1, F.greatest(F.size(items) - by, F.lit(0))), F.slice(items, 1, by)) if by else items


def quarter_starts(first: Column, last: Column) -> Column:
    """The first days of all quarters from that of one day to that of another."""
    return F.sequence(F.to_date(F.trunc(first, "QUARTER")), F.to_date(F.trunc(last, "QUARTER")), F.expr("INTERVAL 3 MONTHS"))
