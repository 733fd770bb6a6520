"""Value rules used everywhere: rounding, validity windows, truthiness, money tolerance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 0) -> Column:
    """Round half towards plus infinity, as a double."""
    p = 10.0**places
    return F.floor(x * p + 0.5).cast("double") / p


def valid_at(as_of: Column, begin: Column, end: Column) -> Column:
    """Closed window, open where a bound is null."""
    return (begin.isNull() | (begin <= as_of)) & (end.isNull() | (end >= as_of))


def blank(x: Column) -> Column:
    """True for null and the empty string."""
    return x.isNull() | (x == "")


def falsy(x: Column) -> Column:
    """True for null and zero."""
    return x.isNull() | (x == 0)


def near_money(a: Column, b: Column, eps: float = 0.03) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(0.02), F.abs(b) * eps)


def number_of(text: Column) -> Column:
    """A number from text: the first comma is the decimal point, blank is 0, anything else is null."""
    t = F.trim(F.regexp_replace(text, "^([^,]*),", "$1."))
    return F.when(t == "", F.lit(0.0)).when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def spread_pct(low: Column, high: Column, empty: float | None = None) -> Column:
    """(high - low) / low in per cent with one place; ``empty`` where low is not positive."""
    return F.when(low > 0, half_up((high - low) / low * 100, 1)).otherwise(F.lit(empty).cast("double"))


def ratio_pct(part: Column, total: Column) -> Column:
    """Share in per cent with one place; the denominator is at least 1."""
    return half_up(part / F.greatest(total, F.lit(1)) * 100, 1)


def day(ts: Column) -> Column:
    """The day as text, in the session's time zone (UTC)."""
    return F.date_format(ts, "yyyy-MM-dd")


def ranking_price(price: Column, original: Column, club: Column, public: Column | None = None) -> Column:
    """What everyone pays: the public price, or the original price of a members' offer, or the price."""
    found = F.when(club & original.isNotNull(), original).otherwise(price)
    return found if public is None else F.coalesce(public, found)


def club_fields(price: Column, original: Column, club: Column, public: Column, member: Column, membership: Column) -> Column:
    """struct(public_price, member_price, requires_membership, membership_name) that a card shows."""
    return F.struct(ranking_price(price, original, club, public).alias("public_price"), member.alias("member_price"), F.coalesce(club, F.lit(False)).alias("requires_membership"), membership.alias("membership_name"))


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` worked out once, however often it is named."""
    return F.get(F.transform(F.array(x), use), F.lit(0))
