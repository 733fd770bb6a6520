"""Flyers and flows through time: discovery, validity, expiry, purge, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.functions.dates import backoff_hours
from pricewell.operators.filters import expirable, purgeable
from pricewell.operators.grouped import replay
from pricewell.operators.keyed import components
from pricewell.sources.scratch import kept


def expire(flyers: DataFrame, as_of: Column) -> DataFrame:
    over = expirable(F.col("status"), F.col("valid_until"), as_of)
    return flyers.withColumns({"expired_at": F.when(over, as_of).otherwise(F.col("expired_at")), "updated_at": F.when(over, as_of).otherwise(F.col("updated_at")), "status": F.when(over, "expired").otherwise(F.col("status"))})


def purge(flyers: DataFrame, pages: DataFrame, offers: DataFrame, as_of: Column, days: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flyers, pages, offers) without evidence past its retention; offers stay and remember where they came from."""
    gone = flyers.filter(purgeable(F.col("status"), F.col("valid_until"), as_of, days)).select(F.col("id").alias("flyer_id"), F.col("title").alias("_t"), F.col("original_url").alias("_u"), F.col("file_hash").alias("_h"))
    kept = offers.join(gone, "flyer_id", "left")
    for name, told in (("source_title", "_t"), ("source_url", "_u"), ("source_hash", "_h")):
        old = F.col(name) if name in offers.columns else F.lit(None).cast("string")
        kept = kept.withColumn(name, F.coalesce(F.col(told), old))
    ids = gone.select("flyer_id")
    return flyers.join(ids.withColumnRenamed("flyer_id", "id"), "id", "left_anti"), pages.join(ids, "flyer_id", "left_anti"), kept.drop("_t", "_u", "_h")


def set_validity(flyers: DataFrame, offers: DataFrame, changes: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(flyers, offers) with new windows from changes (id, valid_from, valid_until); null clears a bound.

    A change whose beginning lies behind its end is an error. A flyer that is valid again is no longer expired.
    """
    c = changes.select("id", F.lit(True).alias("_hit"), F.when(F.col("valid_from") > F.col("valid_until"), F.raise_error(F.lit("valid_from lies after valid_until")).cast("timestamp")).otherwise(F.col("valid_from")).alias("_f"), F.col("valid_until").alias("_u"))
    pick = lambda name, new: F.when(F.col("_hit"), F.col(new)).otherwise(F.col(name))
    again = F.col("_hit") & (F.col("status") == "expired") & (F.col("_u").isNull() | (F.col("_u") >= as_of))
    f = flyers.join(c, "id", "left").withColumns({"status": F.when(again, "processed").otherwise(F.col("status")), "valid_from": pick("valid_from", "_f"), "valid_until": pick("valid_until", "_u")}).drop("_hit", "_f", "_u")
    o = offers.join(c.withColumnRenamed("id", "flyer_id"), "flyer_id", "left").withColumns({"valid_from": pick("valid_from", "_f"), "valid_until": pick("valid_until", "_u")}).drop("_hit", "_f", "_u")
    return f, o


FOUND = ["title", "external_id", "original_url", "valid_from", "valid_until", "store_ids", "page_urls"]


def discover(flyers: DataFrame, found: DataFrame, as_of: Column) -> DataFrame:
    """Flyers with what a crawl found, one find after the other in the order of ``found_at``.

    A find belongs to the first flyer (by created_at, id) of its market that has its URL, else its external id, else it is a new flyer. Found values replace old ones
    where there are any, so a later find sees the URL and external id that an earlier one has set. A flyer without a stored file
    whose pages are known is queued for download again, unless it is in work or expired.

    Finds and flyers that share a URL or an external id, directly or through others, form a component; components are independent, so the order is kept within each and a
    large market is many small groups. Only a row with both a URL and an external id joins two keys, so labels spread over these pairs alone; any other URL is a component by
    itself. Flyers that no find touches are passed through.
    """
    url, ext = F.concat_ws("|", F.lit("u"), "supermarket_id", "original_url"), F.when(F.col("external_id") != "", F.concat_ws("|", F.lit("e"), "supermarket_id", "external_id"))
    finds = found.select(*[F.col(c) for c in found.columns], F.sha2(F.concat_ws("|", "supermarket_id", "original_url", F.col("found_at").cast("string")), 256).alias("_new"), F.xxhash64(*found.columns).alias("_tie"), as_of.alias("_as_of"), url.alias("_url"), ext.alias("_ext"))
    finds = kept(finds, "finds")
    asked = finds.select(F.explode(F.array("_url", "_ext")).alias("key")).filter("key IS NOT NULL").distinct()
    own = flyers.select("id", F.explode(F.array(F.struct(F.lit(True).alias("by_url"), url.alias("key")), F.struct(F.lit(False).alias("by_url"), ext.alias("key")))).alias("k")).select("id", "k.*").filter("key IS NOT NULL")
    own = own.join(asked, "key", "left_semi").groupBy("id").agg(F.max(F.when(F.col("by_url"), F.col("key"))).alias("_url"), F.max(F.when(~F.col("by_url"), F.col("key"))).alias("_ext"))
    own = kept(own, "touched")
    pairs = kept(finds.select("_url", "_ext").unionByName(own.select("_url", "_ext")).filter("_url IS NOT NULL AND _ext IS NOT NULL").distinct(), "pairs")
    label = components(pairs.select(F.col("_url").alias("node"), F.col("_ext").alias("key"))).withColumnRenamed("node", "_url")
    by_url = lambda df: df.join(label, "_url", "left").withColumn("label", F.coalesce("label", "_url"))
    # an external id that was asked for stands in some find's pair; it labels the flyers that are known by it alone
    by_ext = pairs.join(label, "_url").select("_ext", "label").distinct()
    labelled = by_url(own.filter("_url IS NOT NULL")).select("id", "label").unionByName(own.filter("_url IS NULL").join(by_ext, "_ext").select("id", "label"))
    mine = flyers.join(labelled, "id")
    theirs = by_url(finds).drop("_url", "_ext")
    columns = flyers.columns
    both = mine.withColumn("_find", F.lit(False)).unionByName(theirs.withColumn("_find", F.lit(True)), allowMissingColumns=True)
    schema = T.StructType([*flyers.schema.fields, *[f for f in found.schema.fields if f.name not in columns and f.name != "found_at"]])

    def turns(rows: list[dict]) -> list[dict]:
        here = sorted((r for r in rows if not r["_find"]), key=lambda r: (r["created_at"] is None, r["created_at"] or 0, r["id"]))
        for f in sorted((r for r in rows if r["_find"]), key=lambda r: (r["found_at"], r["_tie"])):
            same = lambda c: next((r for r in here if f[c] and r[c] == f[c]), None)  # noqa: E731, B023
            hit = same("original_url") or same("external_id")
            if hit is None:
                here.append({**f, "id": f["_new"], "status": "discovered", "created_at": f["_as_of"], "updated_at": f["_as_of"]})
                continue
            if f["page_urls"] and not hit["storage_id"] and hit["status"] not in ("processing", "expired"):
                hit["status"] = "discovered"
            told = {c: f[c] for c in FOUND if f[c] is not None and (f[c] or c not in ("title", "external_id", "original_url", "page_urls"))}
            hit.update(told, updated_at=f["_as_of"])
        return here

    done = replay(both, ["label"], [], turns, schema)
    return flyers.join(own.select("id"), "id", "left_anti").unionByName(done, allowMissingColumns=True)


def arm(flows: DataFrame, markets: DataFrame, at: Column) -> DataFrame:
    """Active flows of some markets run at ``at`` or at the earlier time that is set."""
    hit = markets.select("supermarket_id").distinct().withColumn("_m", F.lit(True))
    met = flows.join(hit, "supermarket_id", "left")
    return met.withColumn("next_run_at", F.when(F.col("_m") & (F.col("status") == "active"), F.least(F.col("next_run_at"), at)).otherwise(F.col("next_run_at"))).drop("_m")


def arm_periodic(flows: DataFrame, as_of: Column, hours: int = 6) -> DataFrame:
    """No active flow waits longer than ``hours`` since its last run."""
    due = F.coalesce(F.col("last_run_at") + F.make_interval(hours=F.lit(hours)), as_of)
    return flows.withColumn("next_run_at", F.when(F.col("status") == "active", F.least(F.col("next_run_at"), due)).otherwise(F.col("next_run_at")))


ATTEMPTS, RECHECK_HOURS = 4, 6


def run_steps(flows: DataFrame, results: DataFrame, most: int = ATTEMPTS, hours: int = RECHECK_HOURS) -> DataFrame:
    """Each result (id, at, ok, new_flyers, error) with the state of its flow after it: status, attempts, next_run_at and, where one is due, an error message.

    Results of a flow count in the order of ``at``. Success clears the attempts; if it brought nothing new the next check is in ``hours``, else the plan stays. A lost scope is an
    error at once and leaves the plan alone. Any other failure doubles the wait, up to eight hours, and is an error from the ``most``-th on. An error stays until somebody clears it.

    The attempts are failures since the last result that sets them, so a running count over the flow's results gives them without a loop.
    """
    c = F.col
    order = Window.partitionBy("id").orderBy("at", "_tie")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = flows.select("id", c("status").alias("_status"), F.coalesce("discovery_attempts", F.lit(0)).alias("_had"), c("next_run_at").alias("_plan"))
    r = results.select("id", "at", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("new_flyers", F.lit(0)).alias("new_flyers"), F.coalesce("error", F.lit("")).alias("error")).withColumn("_tie", F.xxhash64("ok", "new_flyers", "error"))
    r = r.join(own, "id")
    lost = ~c("ok") & F.contains("error", F.lit("SCOPE_NOT_FOUND"))
    r = r.withColumn("_lost", lost).withColumn("_base", F.when(c("ok"), 0).when(lost, most)).withColumn("_sets", F.sum(c("_base").isNotNull().cast("int")).over(upto))
    fails = F.sum(c("_base").isNull().cast("int")).over(Window.partitionBy("id", "_sets").orderBy("at", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = F.coalesce(F.last("_base", ignorenulls=True).over(upto), c("_had"))
    r = r.withColumn("attempts", (start + fails).cast("int"))
    r = r.withColumn("_bad", c("_lost") | (~c("ok") & (c("attempts") >= most)))
    was = (c("_status") == "error") | F.coalesce(F.max("_bad").over(before), F.lit(False))
    wait = F.when(c("ok") & (c("new_flyers") <= 0), F.lit(float(hours))).when(~c("ok") & ~c("_lost"), backoff_hours(c("attempts")))
    plan = F.when(wait.isNotNull(), c("at") + F.make_interval(hours=wait.cast("int")))
    said = F.when(c("error") != "", c("error")).otherwise(F.concat(F.lit("Discovery failed after "), c("attempts").cast("string"), F.lit(" attempts")))
    return r.select(
        "id", "at", "attempts", F.when(was | c("_bad"), "error").otherwise(c("_status")).alias("status"),
        F.coalesce(F.last(plan, ignorenulls=True).over(upto), c("_plan")).alias("next_run_at"),
        F.when(F.when(c("_lost"), ~was).otherwise(c("_bad")), said).alias("message"), "_tie",
    )


def record_runs(flows: DataFrame, results: DataFrame, most: int = ATTEMPTS, hours: int = RECHECK_HOURS) -> tuple[DataFrame, DataFrame]:
    """(flows after their results, rows for the table of errors); see ``run_steps``."""
    steps = run_steps(flows, results, most, hours)
    last = steps.groupBy("id").agg(F.max_by(F.struct("at", "attempts", "status", "next_run_at"), F.struct("at", "_tie")).alias("_r"))
    met = flows.join(last, "id", "left")
    pick = lambda name, new: F.when(F.col("_r").isNotNull(), F.col("_r")[new]).otherwise(F.col(name)).alias(name)
    changed = {"status": "status", "discovery_attempts": "attempts", "last_run_at": "at", "next_run_at": "next_run_at"}
    after = met.select(*[pick(c, changed[c]) if c in changed else F.col(c) for c in flows.columns])
    errors = steps.filter("message IS NOT NULL").join(flows.select("id", "supermarket_id"), "id")
    return after, errors.select("id", "supermarket_id", F.lit("DISCOVERY").alias("stage"), "message", F.lit("open").alias("status"), F.col("at").alias("created_at"))


def to_discover(flyers: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """(supermarket_id): markets where a flyer expires now and none is to come at any time, or where a live one ends within ``hours``."""
    live = ~F.col("status").isin("failed", "expired")
    over = flyers.filter(expirable(F.col("status"), F.col("valid_until"), as_of)).select("supermarket_id")
    coming = flyers.filter(live & (F.col("valid_from") > as_of)).select("supermarket_id").distinct()
    ending = flyers.filter(live & F.col("valid_until").between(as_of, as_of + F.make_interval(hours=F.lit(hours)))).select("supermarket_id")
    return over.join(coming, "supermarket_id", "left_anti").unionByName(ending).distinct()


def sweep(flyers: DataFrame, pages: DataFrame, offers: DataFrame, flows: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The hourly job over (flyers, pages, offers, flows).

    Flyers expire; flows of markets to be looked at are armed; flyers that had expired before and are past their retention lose their evidence, while
    their offers stay; duplicates go with pages and offers.
    """
    kept, pages, offers = purge(flyers, pages, offers, as_of)
    double = kept.filter("status = 'duplicate'").select(F.col("id").alias("flyer_id"))
    left = expire(kept.filter("status <> 'duplicate'"), as_of)
    gone = lambda df: df.join(double, "flyer_id", "left_anti")
    return left, gone(pages), gone(offers), arm_periodic(arm(flows, to_discover(flyers, as_of), as_of), as_of)
