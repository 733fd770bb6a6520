"""Lists with optional filters: a predicate is added only for a filter that is set."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.functions.parse import TYPE_RANK
from pricewell.functions.text import first_word, normalize
from pricewell.operators.filters import eligibility_is


def flyer_list(flyers: DataFrame, supermarket_id: str | None = None, source_id: str | None = None, status: str | None = None, without_duplicates: bool = False, missing_validity: bool = False, begin: datetime | None = None, end: datetime | None = None) -> DataFrame:
    if supermarket_id is not None:
        flyers = flyers.filter(F.col("supermarket_id") == supermarket_id)
    if source_id is not None:
        flyers = flyers.filter(F.col("source_id") == source_id)
    if status is not None:
        flyers = flyers.filter(F.col("status") == status)
    if without_duplicates:
        flyers = flyers.filter("status <> 'duplicate'")
    if missing_validity:
        flyers = flyers.filter("valid_from IS NULL OR valid_until IS NULL")
    if begin is not None:
        flyers = flyers.filter(F.col("valid_until") >= F.lit(begin))
    if end is not None:
        flyers = flyers.filter(F.col("valid_from") <= F.lit(end))
    return flyers


def offer_list(offers: DataFrame, flyer_id: str | None = None, supermarket_id: str | None = None, validation_status: str | None = None, eligibility: str | None = None) -> DataFrame:
    for name, value in (("flyer_id", flyer_id), ("supermarket_id", supermarket_id), ("validation_status", validation_status)):
        if value is not None:
            offers = offers.filter(F.col(name) == value)
    return offers if eligibility is None else offers.filter(eligibility_is(F.col("eligibility"), eligibility))


def contains_text(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows where some column holds the folded query; a blank query keeps all."""
    hit = F.lit(query.strip() == "")
    for c in columns:
        hit = hit | F.coalesce(F.contains(normalize(F.col(c)), normalize(F.lit(query))), F.lit(False))
    return df.filter(hit)


def worker_list(workers: DataFrame, as_of: Column, networks: list[str] | None = None, stores: list[str] | None = None, sources: list[str] | None = None, health: list[str] | None = None, parse_below: float | None = None, jobs: str | None = None) -> DataFrame:
    """All set filters must hold; of ``health`` (fail, stale, low_parse) any."""
    if networks:
        workers = workers.filter(first_word(F.col("supermarket_name")).isin(networks))
    if stores:
        workers = workers.filter(F.col("supermarket_id").isin(stores))
    if sources:
        workers = workers.filter(F.arrays_overlap("source_kinds", F.array(*map(F.lit, sources))))
    if health:
        stale = (F.col("status") != "running") & (F.col("last_run_at").isNull() | (F.col("last_run_at") < as_of - F.make_interval(days=F.lit(1))))
        tests = {"fail": F.col("status") == "fail", "stale": stale, "low_parse": F.coalesce(F.col("parse_rate") < 0.8, F.lit(False))}
        hit = F.lit(False)
        for h in health:
            hit = hit | tests[h]
        workers = workers.filter(hit)
    if parse_below is not None:
        workers = workers.filter(F.col("parse_rate") < parse_below)
    if jobs == "zero":
        workers = workers.filter("jobs_24h = 0")
    elif jobs == "some":
        workers = workers.filter("jobs_24h > 0")
    return workers


def without_denied(found: DataFrame, denied: DataFrame) -> DataFrame:
    """Rows whose URL or title, in lower case, is on no list of ``denied`` (key)."""
    keys = denied.select(F.lower("key").alias("_k")).distinct()
    by_url = found.withColumn("_k", F.lower("url")).join(keys, "_k", "left_anti")
    return by_url.withColumn("_k", F.lower("title")).join(keys, "_k", "left_anti").drop("_k")


def public_condition(eligibility: Column, conditions: Column, labels: dict[str, str] | None = None) -> Column:
    """struct(kind, text) for a card: none, unknown, or the conditions in a line."""
    kind = F.coalesce(eligibility, F.lit("ALL_CUSTOMERS"))
    line = lambda c: F.array_join(F.array_distinct(F.filter(F.array(F.trim(c["name"]), F.trim(c["description"]), F.trim(c["requirement"])), lambda x: x.isNotNull() & (x != ""))), " · ")
    parts = F.array_join(F.filter(F.coalesce(F.transform(conditions, line), F.array().cast("array<string>")), lambda x: x != ""), " · ")
    label = kind
    for k, v in (labels or {}).items():
        label = F.when(kind == k, v).otherwise(label)
    text = F.when(kind == "ALL_CUSTOMERS", "Todos").when(kind == "UNKNOWN", "Condição não identificada").when(parts != "", parts).otherwise(label)
    return F.struct(F.when(kind == "ALL_CUSTOMERS", "none").when(kind == "UNKNOWN", "unknown").otherwise("ok").alias("kind"), text.alias("text"))


def condition_drafts(eligibility: Column, conditions: Column) -> Column:
    """array(struct(type, name, description)) to edit: the conditions, or one of the eligibility alone; unknown types are UNKNOWN."""
    kind = lambda t: F.when(t.isin(*TYPE_RANK), t).otherwise(F.lit("UNKNOWN"))
    line = lambda c: F.array_join(F.filter(F.array(F.trim(c["description"]), F.trim(c["requirement"])), lambda x: x.isNotNull() & (x != "")), " · ")
    draft = lambda t, n, d: F.struct(t.alias("type"), n.alias("name"), d.alias("description"))
    alone = F.when(F.coalesce(eligibility, F.lit("ALL_CUSTOMERS")) != "ALL_CUSTOMERS", F.array(draft(kind(eligibility), F.lit(""), F.lit(""))))
    many = F.transform(conditions, lambda c: draft(F.coalesce(kind(c["type"]), F.lit("UNKNOWN")), F.coalesce(F.trim(c["name"]), F.lit("")), line(c)))
    return F.coalesce(F.when(F.size(conditions) > 0, many), alone, F.array().cast("array<struct<type:string,name:string,description:string>>"))
