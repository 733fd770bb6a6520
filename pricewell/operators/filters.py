"""Row predicates over offers, flyers and flows; each takes the instant it is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewell.functions.semantics import blank, falsy, valid_at


def offer_valid(status: Column, begin: Column, end: Column, as_of: Column) -> Column:
    return (status == "validated") & valid_at(as_of, begin, end)


def flyer_current(status: Column, begin: Column, end: Column, as_of: Column) -> Column:
    return ~status.isin("expired", "failed") & valid_at(as_of, begin, end)


def flyer_active(status: Column, end: Column, as_of: Column) -> Column:
    """Without a look at the beginning; not the same as ``flyer_current``."""
    return ~status.isin("expired", "failed") & (end.isNull() | (end >= as_of))


def expirable(status: Column, end: Column, as_of: Column) -> Column:
    return F.coalesce(end < as_of, F.lit(False)) & ~status.isin("expired", "failed", "downloading", "processing")


def near_expiry(status: Column, end: Column, as_of: Column, hours: int) -> Column:
    return end.between(as_of, as_of + F.make_interval(hours=F.lit(hours))) & status.isin("processed", "downloaded", "partially_processed")


def purgeable(status: Column, end: Column, as_of: Column, days: int = 30) -> Column:
    """What ``purge_batch`` takes some of."""
    return (status == "expired") & (end <= as_of - F.make_interval(days=F.lit(days)))


def pending_extract(status: Column, begin: Column, as_of: Column, hours: int = 24) -> Column:
    return status.isin("downloaded", "partially_processed") & (begin.isNull() | (begin <= as_of + F.make_interval(hours=F.lit(hours))))


def extract_skip_reason(begin: Column, end: Column, as_of: Column, hours: int = 24) -> Column:
    return F.when(end < as_of, "expired").when(begin > as_of + F.make_interval(hours=F.lit(hours)), "far_future")


def due(status: Column, next_run: Column, as_of: Column) -> Column:
    return (status == "active") & (next_run <= as_of)


def stale(status: Column, last_run: Column, as_of: Column, hours: int) -> Column:
    return (status == "active") & (last_run.isNull() | (last_run < as_of - F.make_interval(hours=F.lit(hours))))


def eligibility_is(column: Column, value: str) -> Column:
    """Null stands for ALL_CUSTOMERS."""
    return F.coalesce(column, F.lit("ALL_CUSTOMERS")) == value


def lacks_brand(brand_id: Column, brand: Column) -> Column:
    return blank(brand_id.cast("string")) & blank(brand)


def lacks_quantity(quantity: Column, value: Column) -> Column:
    return blank(quantity) & falsy(value)


def lacks_unit(unit: Column, normalized: Column, value: Column) -> Column:
    return ~blank(unit) & blank(normalized) & falsy(value)


def validation_status(name: Column, price: Column, confidence: Column) -> Column:
    """rejected, validated or suspicious; a missing confidence is 0.7."""
    conf = F.coalesce(confidence, F.lit(0.7))
    return (
        F.when((F.length(name) < 4) | (price <= 0), "rejected")
        .when(conf < 0.5, "rejected")
        .when((conf >= 0.8) & price.between(0.1, 5000), "validated")
        .when(~price.between(0.1, 5000), "suspicious")
        .otherwise("validated")
    )


def ops_status(flow: Column, last: Column, jobs: Column) -> Column:
    """State of a worker from its flow's status, its last run's and its runs of the day; the first that holds."""
    return (
        F.when(flow == "error", "fail")
        .when(last == "cancelled", "queue")
        .when(last == "duplicate", "review")
        .when(last == "failed", "fail")
        .when(last == "running", "running")
        .when((last == "partial") | (flow == "testing"), "review")
        .when((flow == "active") & (jobs > 0), "running")
        .otherwise("queue")
    )


def run_queue(status: Column, suspicious: Column, pending: Column) -> Column:
    """Where a run stands: blocked, review, fila or done."""
    return F.when(status == "failed", "blocked").when((suspicious > 0) | (status == "partial"), "review").when(pending > 0, "fila").otherwise("done")


def source_status(explicit: Column, active: Column, kind: Column, flow_id: Column) -> Column:
    return F.coalesce(explicit, F.when(~active, "inactive").when((kind != "manual") & flow_id.isNull(), "not_configured").otherwise("active"))


def source_kinds(types: Column, url: Column) -> Column:
    """api, pdf or html of each step; by the URL where there is none."""
    own = F.array_distinct(F.transform(types, lambda t: F.when(t == "dynamic", "api").when(t == "pdf", "pdf").otherwise("html")))
    return F.when(F.coalesce(F.size(types), F.lit(0)) > 0, own).otherwise(F.array(F.when(url.rlike(r"(?i)\.pdf(\?|$)"), "pdf").otherwise("html")))


def quality_points(*pairs: tuple[Column, int]) -> Column:
    """Sum of the points whose condition holds."""
    total = F.lit(0)
    for cond, points in pairs:
        total = total + F.when(cond, points).otherwise(0)
    return total


def in_x_domain(t: Column, a: Column, b: Column) -> Column:
    return t.between(F.least(a, b), F.greatest(a, b))


def retention(status: Column, end: Column, days: int = 30) -> Column:
    """Until when an expired flyer's evidence stays; null for others."""
    return F.when(status == "expired", end + F.make_interval(days=F.lit(days)))


def offer_score(name: Column, price: Column, brand: Column, external: Column, image: Column, url: Column) -> Column:
    """Points of a raw record, 10 for being there."""
    there = lambda c: ~blank(c)
    return quality_points((F.length(name) >= 3, 20), (price > 0, 20), (there(brand), 15), (there(external), 15), (there(image), 10), (there(url), 10)) + 10


def run_outcome(error: Column, ok: Column, duplicates: Column, new: Column) -> Column:
    cancelled = F.coalesce(error == "cancelled", F.lit(False))
    return F.when(cancelled, "cancelled").when(ok & (duplicates > 0) & (new == 0), "duplicate").when(ok, "success").otherwise("failed")


# What is wrong with an offer of a queue.
FIX_REASONS = {"brand": "Marca ausente", "qty": "Quantidade ausente", "unit": "Unidade inválida"}


def fix_reason(fix: Column) -> Column:
    return F.when(fix == "brand", FIX_REASONS["brand"]).when(fix == "qty", FIX_REASONS["qty"]).otherwise(FIX_REASONS["unit"])


def offer_tab(tab: str, status: Column, price: Column, original: Column) -> Column:
    tests = {"active": status == "validated", "drop": F.coalesce(original > price, F.lit(False)), "novo": original.isNull(), "expired": status == "rejected"}
    return tests.get(tab, F.lit(True))


def flyer_tab(tab: str, status: Column, end: Column, offers: Column, as_of: Column) -> Column:
    live = flyer_active(status, end, as_of)
    ends = F.coalesce(end < as_of + F.make_interval(days=F.lit(2)), F.lit(False))
    tests = {"vigente": live, "expiring": live & ends, "noparse": status.isin("failed", "discovered") | ((status == "downloaded") & (offers == 0))}
    return tests.get(tab, F.lit(True))


def product_tab(tab: str, markets: Column, spread: Column) -> Column:
    return {"single": markets == 1, "multi": markets >= 2, "spread": F.coalesce(spread > 40, F.lit(False))}.get(tab, F.lit(True))


def low_contains(needle: str, *columns: Column) -> Column:
    """Some column holds the text, whatever the case; all rows for a blank text."""
    hit = F.lit(needle.strip() == "")
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(needle.strip().lower())), F.lit(False))
    return hit
