"""Flyers, flows and runs through time: sweeps, discovery, schedules, dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.functions.dates import calendar, quarter_starts, rotate, sunday_week, week_column, week_count, week_overlaps, year_start
from pricewell.functions.semantics import half_up
from pricewell.functions.text import worker_slug
from pricewell.operators import filters, lifecycle
from pricewell.operators.joins import range_counts, range_marks, touched_or_filled
from pricewell.operators.keyed import clamp, unique_row
from pricewell.operators.listing import flyer_list, worker_list, without_denied
from pricewell.plans.frames import cte, day, frame, half
from pricewell.registry import query
from pricewell.sources.tables import table

NOW, AT = "2000-06-01", "2024-01-30"
_NOW, _AT = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{AT}'"
_EXPIRES = f"valid_until < {_NOW} AND status NOT IN ('expired', 'failed', 'downloading', 'processing')"
_DISCOVER = f"""discover AS (SELECT supermarket_id FROM flyers WHERE {_EXPIRES} AND supermarket_id NOT IN (SELECT supermarket_id FROM flyers WHERE status NOT IN ('failed', 'expired') AND valid_from > {_NOW})
  UNION SELECT supermarket_id FROM flyers WHERE status NOT IN ('failed', 'expired') AND valid_until BETWEEN {_NOW} AND {_NOW} + INTERVAL 24 HOUR)"""


def _now(x: str = NOW):
    return F.lit(x).cast("timestamp_ntz")


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)


@query("upcoming_anti_join", f"WITH {cte('flyers')}, {_DISCOVER} SELECT supermarket_id FROM discover")
def upcoming_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets to look at: a flyer expires and none is to come, or a live one ends within a day."""
    return lifecycle.to_discover(frame(spark, sf_dir, "flyers"), _now())


def _children(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    pages = f.select(F.col("id").alias("flyer_id"), F.lit(1).alias("page_number"))
    offers = f.select(F.concat(F.lit("o"), "id").alias("id"), F.col("id").alias("flyer_id"))
    return pages, offers


@query("lifecycle_sweep", f"""WITH {cte('flyers')}, k AS (SELECT * FROM flyers WHERE NOT coalesce(status = 'expired' AND valid_until <= {_NOW} - INTERVAL 30 DAY, false) AND status <> 'duplicate')
SELECT id, CASE WHEN {_EXPIRES} THEN 'expired' ELSE status END AS status, coalesce({_EXPIRES}, false) AS expired_now FROM k""")
def lifecycle_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flyers after the hourly job: expired, purged, without duplicates."""
    f = frame(spark, sf_dir, "flyers").withColumn("expired_at", F.lit(None).cast("timestamp_ntz"))
    left, *_ = lifecycle.sweep(f, *_children(f), frame(spark, sf_dir, "flows").limit(0), _now())
    return left.select("id", "status", F.col("expired_at").isNotNull().alias("expired_now"))


@query("swept_evidence", f"""WITH {cte('flyers')}, gone AS (SELECT id, title FROM flyers WHERE status = 'expired' AND valid_until <= {_NOW} - INTERVAL 30 DAY), d AS (SELECT id FROM flyers WHERE status = 'duplicate')
SELECT 'o' || f.id AS id, g.title AS source_title, f.id IN (SELECT id FROM gone) AS evidence_gone FROM flyers f LEFT JOIN gone g ON g.id = f.id WHERE f.id NOT IN (SELECT id FROM d)""")
def swept_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers outlive the evidence of purged flyers and remember where they came from; those of duplicates go."""
    f = frame(spark, sf_dir, "flyers").withColumn("expired_at", F.lit(None).cast("timestamp_ntz"))
    _, pages, offers, _ = lifecycle.sweep(f, *_children(f), frame(spark, sf_dir, "flows").limit(0), _now())
    return offers.join(pages.select("flyer_id", F.lit(True).alias("p")), "flyer_id", "left").select("id", "source_title", F.col("p").isNull().alias("evidence_gone"))


@query("purge_batch", f"WITH {cte('flyers')} SELECT id FROM flyers WHERE status = 'expired' AND valid_until <= {_NOW} - INTERVAL 30 DAY ORDER BY valid_until, n LIMIT 100")
def purge_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred oldest flyers whose evidence may go; a larger wish is cut to that."""
    f = frame(spark, sf_dir, "flyers")
    return f.filter(filters.purgeable(F.col("status"), F.col("valid_until"), _now())).orderBy("valid_until", "n").limit(clamp(5000, 1, 100, 20)).select("id")


@query("armed_flows", f"""WITH {cte('flyers', 'flows')}, {_DISCOVER}, a AS (SELECT f.*, CASE WHEN status = 'active' AND supermarket_id IN (SELECT supermarket_id FROM discover) THEN least(coalesce(next_run_at, {_NOW}), {_NOW}) ELSE next_run_at END AS n1 FROM flows f)
SELECT id, {day(f"CASE WHEN status = 'active' THEN least(coalesce(n1, coalesce(last_run_at + INTERVAL 6 HOUR, {_NOW})), coalesce(last_run_at + INTERVAL 6 HOUR, {_NOW})) ELSE n1 END")} AS next_run_at FROM a""")
def armed_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When flows run next: those of markets to be looked at now, no active one later than six hours after its last run."""
    flows = lifecycle.arm(frame(spark, sf_dir, "flows"), lifecycle.to_discover(frame(spark, sf_dir, "flyers"), _now()), _now())
    return lifecycle.arm_periodic(flows, _now()).select("id", _stamp("next_run_at"))


_RESULTS = "SELECT user_id AS id, ts, event_type <> 'error' AND event_id % 5 > 1 AS ok, CAST(event_id % 3 AS INTEGER) AS new_flyers, CASE WHEN event_id % 97 = 0 THEN 'page: SCOPE_NOT_FOUND' WHEN event_id % 4 = 0 THEN 'HTTP 500' END AS error{more} FROM {events}"
# one result after the other, as the rules are stated
_STEPS = f"""r AS ({_RESULTS.format(more=", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS j", events="events")}),
k AS (SELECT *, NOT ok AND contains(coalesce(error, ''), 'SCOPE_NOT_FOUND') AS lost FROM r),
t AS (SELECT id, 0::BIGINT AS j, last_run_at AS ran, status, discovery_attempts AS attempts, next_run_at AS plan, CAST(NULL AS VARCHAR) AS message FROM flows
  UNION ALL SELECT t.id, k.j, k.ts, CASE WHEN ok THEN t.status WHEN lost OR t.attempts + 1 >= 4 THEN 'error' ELSE t.status END, CASE WHEN ok THEN 0 WHEN lost THEN 4 ELSE t.attempts + 1 END,
    CASE WHEN ok AND new_flyers > 0 OR lost THEN t.plan WHEN ok THEN k.ts + INTERVAL 6 HOUR ELSE k.ts + to_hours(CAST(least(8, pow(2, t.attempts)) AS INTEGER)) END,
    CASE WHEN lost AND t.status <> 'error' THEN error WHEN NOT ok AND NOT lost AND t.attempts + 1 >= 4 THEN coalesce(error, 'Discovery failed after ' || (t.attempts + 1) || ' attempts') END
  FROM t JOIN k ON k.id = t.id AND k.j = t.j + 1)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RESULTS.format(more="", events="{events}"), events=table(spark, sf_dir, "events")).withColumnRenamed("ts", "at")


@query("recorded_runs", f"""WITH RECURSIVE {cte('flows')}, {_STEPS}, e AS (SELECT id, max(j) AS j FROM t GROUP BY id)
SELECT id, status, attempts AS discovery_attempts, {day('ran')} AS last_run_at, {day('plan')} AS next_run_at FROM t JOIN e USING (id, j)""")
def recorded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows after all their checks: success resets, failures double the wait up to eight hours and end in error at the fourth, a lost scope at once."""
    after, _ = lifecycle.record_runs(frame(spark, sf_dir, "flows"), _results(spark, sf_dir))
    return after.select("id", "status", "discovery_attempts", _stamp("last_run_at"), _stamp("next_run_at"))


@query("run_errors", f"WITH RECURSIVE {cte('flows')}, {_STEPS} SELECT t.id, supermarket_id, message, {day('ran')} AS created_at FROM t JOIN flows USING (id) WHERE message IS NOT NULL")
def run_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What these checks put into the table of errors."""
    _, errors = lifecycle.record_runs(frame(spark, sf_dir, "flows"), _results(spark, sf_dir))
    return errors.select("id", "supermarket_id", "message", _stamp("created_at"))


@query("discovered_flyers", f"""WITH RECURSIVE {cte('flyers')},
found AS (SELECT n * 4 + 1 AS node, supermarket_id, original_url AS url, CAST(NULL AS VARCHAR) AS ext, 'T' || CAST(n % 3 AS STRING) AS title, 1 AS seq FROM flyers WHERE n % 2 = 0
  UNION ALL SELECT n * 4 + 2, supermarket_id, original_url || '?new', coalesce(external_id, 'e' || CAST(n AS STRING)), CASE WHEN n % 10 = 0 THEN 'N' END, 2 FROM flyers WHERE n % 5 = 0
  UNION ALL SELECT n * 4 + 3, supermarket_id, original_url || '?alt', coalesce(external_id, 'e' || CAST(n AS STRING)), CASE WHEN n % 3 = 0 THEN 'A' || CAST(n AS STRING) END, 3 FROM flyers WHERE n % 5 = 0),
keys AS (SELECT 'n' || node AS node, 'u' || supermarket_id || '|' || url AS key FROM found UNION ALL SELECT 'n' || node, 'e' || supermarket_id || '|' || ext FROM found WHERE ext IS NOT NULL
  UNION ALL SELECT 'f' || id, 'u' || supermarket_id || '|' || original_url FROM flyers UNION ALL SELECT 'f' || id, 'e' || supermarket_id || '|' || external_id FROM flyers WHERE external_id IS NOT NULL),
reach(node, root) AS (SELECT DISTINCT node, node FROM keys WHERE node[1] = 'n' UNION SELECT b.node, reach.root FROM reach JOIN keys a ON a.node = reach.node JOIN keys b ON b.key = a.key),
label AS (SELECT node, min(root) AS label FROM reach GROUP BY node),
old AS (SELECT label, flyers.* FROM label JOIN flyers ON node = 'f' || id),
new AS (SELECT label, found.* FROM label JOIN found ON label.node = 'n' || found.node),
p AS (SELECT label, arg_max(title, seq) FILTER (WHERE title IS NOT NULL) AS title, arg_max(url, seq) AS url, arg_min(sha256(CAST(supermarket_id AS STRING) || '|' || url || '|' || seq), seq) AS id FROM new GROUP BY label)
SELECT f.id, coalesce(p.title, f.title) AS title, coalesce(p.url, f.original_url) AS original_url, CASE WHEN p.label IS NOT NULL AND f.storage_id IS NULL AND f.status NOT IN ('processing', 'expired') THEN 'discovered' ELSE f.status END AS status
FROM flyers f LEFT JOIN old ON old.id = f.id LEFT JOIN p ON p.label = old.label
UNION ALL SELECT id, title, url, 'discovered' FROM p WHERE label NOT IN (SELECT label FROM old)""")
def discovered_flyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flyers after a crawl whose finds also match one another: by URL, else by external id, else new; those without a file are queued again."""
    c = F.col
    null = lambda kind: F.lit(None).cast(kind)
    f = frame(spark, sf_dir, "flyers").withColumns({"store_ids": null("array<string>"), "page_urls": null("array<string>")})
    ext = F.coalesce("external_id", F.concat(F.lit("e"), c("n").cast("string")))
    rest = [null("timestamp_ntz").alias("valid_from"), null("timestamp_ntz").alias("valid_until"), "store_ids", F.array(F.lit("p1"), F.lit("p2")).alias("page_urls"), "source_id"]
    first = f.filter("n % 2 = 0").select("supermarket_id", "original_url", null("string").alias("external_id"), F.concat(F.lit("T"), (c("n") % 3).cast("string")).alias("title"), *rest, F.lit(1).alias("found_at"))
    fresh = f.filter("n % 5 = 0")
    second = fresh.select("supermarket_id", F.concat("original_url", F.lit("?new")).alias("original_url"), ext.alias("external_id"), F.when(c("n") % 10 == 0, "N").alias("title"), *rest, F.lit(2).alias("found_at"))
    third = fresh.select("supermarket_id", F.concat("original_url", F.lit("?alt")).alias("original_url"), ext.alias("external_id"), F.when(c("n") % 3 == 0, F.concat(F.lit("A"), c("n").cast("string"))).alias("title"), *rest, F.lit(3).alias("found_at"))
    return lifecycle.discover(f, first.unionByName(second).unionByName(third), _now()).select("id", "title", "original_url", "status")


@query("repaired_validity", f"""WITH {cte('flyers')}, c AS (SELECT *, n % 3 = 0 AS hit, CASE WHEN n % 6 = 0 THEN NULL ELSE TIMESTAMP '2001-01-01' END AS until FROM flyers)
SELECT id, CASE WHEN hit AND status = 'expired' AND (until IS NULL OR until >= {_NOW}) THEN 'processed' ELSE status END AS status, {day("CASE WHEN hit THEN TIMESTAMP '2000-01-01' ELSE valid_from END")} AS valid_from, {day('CASE WHEN hit THEN until ELSE valid_until END')} AS valid_until FROM c""")
def repaired_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New windows, which may be open; a flyer that is valid again is no longer expired."""
    f = frame(spark, sf_dir, "flyers")
    changes = f.filter("n % 3 = 0").select("id", F.lit("2000-01-01").cast("timestamp_ntz").alias("valid_from"), F.when(F.col("n") % 6 != 0, F.lit("2001-01-01").cast("timestamp_ntz")).alias("valid_until"))
    offers = f.select(F.col("id").alias("flyer_id"), "valid_from", "valid_until").limit(0)
    return lifecycle.set_validity(f, offers, changes, _now())[0].select("id", "status", _stamp("valid_from"), _stamp("valid_until"))


@query("flyer_filters", f"""WITH {cte('flyers')} SELECT id, status IN ('downloaded', 'partially_processed') AND (valid_from IS NULL OR valid_from <= {_NOW} + INTERVAL 24 HOUR) AS pending_extract, CASE WHEN valid_until < {_NOW} THEN 'expired' WHEN valid_from > {_NOW} + INTERVAL 24 HOUR THEN 'far_future' END AS skip_reason, {day("CASE WHEN status = 'expired' THEN valid_until + INTERVAL 30 DAY END")} AS retention,
  status NOT IN ('expired', 'failed') AND (valid_until IS NULL OR valid_until >= {_NOW}) AS tab_vigente, status NOT IN ('expired', 'failed') AND coalesce(valid_until >= {_NOW} AND valid_until < {_NOW} + INTERVAL 2 DAY, false) AS tab_expiring, status IN ('failed', 'discovered') OR (status = 'downloaded' AND n % 2 = 0) AS tab_noparse
FROM flyers WHERE supermarket_id <> 7 AND status <> 'duplicate' AND valid_until >= TIMESTAMP '1999-01-01' AND valid_from <= TIMESTAMP '2001-01-01'""")
def flyer_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests of flyer lists and their tabs, over a filtered list."""
    from datetime import datetime

    f = flyer_list(frame(spark, sf_dir, "flyers").filter("supermarket_id <> 7"), without_duplicates=True, begin=datetime(1999, 1, 1), end=datetime(2001, 1, 1))
    c = F.col
    tabs = [filters.flyer_tab(t, c("status"), c("valid_until"), F.when(c("n") % 2 == 0, 0).otherwise(1), _now()).alias(f"tab_{t}") for t in ("vigente", "expiring", "noparse")]
    return f.select("id", filters.pending_extract(c("status"), c("valid_from"), _now()).alias("pending_extract"), filters.extract_skip_reason(c("valid_from"), c("valid_until"), _now()).alias("skip_reason"), F.date_format(filters.retention(c("status"), c("valid_until")), "yyyy-MM-dd HH:mm").alias("retention"), *tabs)


@query("flow_filters", f"WITH {cte('flows')} SELECT id, coalesce(status = 'active' AND next_run_at <= {_AT}, false) AS due, status = 'active' AND (last_run_at IS NULL OR last_run_at < {_AT} - INTERVAL 24 HOUR) AS stale, coalesce(CASE WHEN id % 7 = 0 THEN 'paused' END, CASE WHEN id % 5 = 0 THEN 'inactive' WHEN id % 2 = 0 AND id % 3 = 0 THEN 'not_configured' ELSE 'active' END) AS source_status FROM flows")
def flow_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows that are due or stale, and the state of their sources."""
    c, k = F.col, F.col("id")
    state = filters.source_status(F.when(k % 7 == 0, "paused"), k % 5 != 0, F.when(k % 2 == 0, "dynamic").otherwise("manual"), F.when(k % 3 != 0, "f"))
    return frame(spark, sf_dir, "flows").select("id", F.coalesce(filters.due(c("status"), c("next_run_at"), _now(AT)), F.lit(False)).alias("due"), filters.stale(c("status"), c("last_run_at"), _now(AT), 24).alias("stale"), state.alias("source_status"))


_RUNS = f"""told AS (SELECT flow_id, arg_max(CASE WHEN status = 'failed' AND error = 'cancelled' THEN 'cancelled' WHEN error = 'duplicate' THEN 'duplicate' ELSE status END, (started_at, id)) AS last, arg_max(error, (started_at, id)) FILTER (WHERE error IS NOT NULL) AS any_error, max(started_at) AS started, count(*) FILTER (WHERE started_at >= {_AT} - INTERVAL 1 DAY) AS jobs, count(*) FILTER (WHERE started_at >= {_AT} - INTERVAL 1 DAY AND status IN ('success', 'duplicate')) AS ok FROM runs GROUP BY flow_id),
workers AS (SELECT f.id, 'wrk_' || substr(trim(regexp_replace(lower(strip_accents(f.name)), '[^a-z0-9]+', '_', 'g'), '_'), 1, 28) AS slug, coalesce(s_name, '—') AS market, coalesce(jobs, 0) AS jobs24h, CASE WHEN jobs > 0 THEN ok / jobs::DOUBLE END AS rate, CASE WHEN f.start_url LIKE '%.pdf?%' THEN 'pdf' ELSE 'html' END AS kinds, coalesce(f.last_run_at, started) AS last_run,
  CASE WHEN f.status = 'error' THEN 'fail' WHEN last = 'cancelled' THEN 'queue' WHEN last = 'duplicate' THEN 'review' WHEN last = 'failed' THEN 'fail' WHEN last = 'running' THEN 'running' WHEN last = 'partial' OR f.status = 'testing' THEN 'review' WHEN f.status = 'active' AND jobs > 0 THEN 'running' ELSE 'queue' END AS ops FROM flows f LEFT JOIN told ON flow_id = f.id LEFT JOIN supplier ON s_suppkey = f.supermarket_id)"""


def _workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each flow with its last run, the day's runs and their success."""
    r, c = frame(spark, sf_dir, "runs"), F.col
    recent = c("started_at") >= _now(AT) - F.expr("INTERVAL 1 DAY")
    kind = F.when((c("status") == "failed") & (c("error") == "cancelled"), "cancelled").when(c("error") == "duplicate", "duplicate").otherwise(c("status"))
    told = r.groupBy(c("flow_id").alias("id")).agg(F.max_by(kind, F.struct("started_at", "id")).alias("last"), F.max("started_at").alias("started"), F.count_if(recent).alias("jobs"), F.count_if(recent & c("status").isin("success", "duplicate")).alias("ok"))
    names = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("supermarket_id"), c("s_name").alias("market"))
    w = frame(spark, sf_dir, "flows").join(told, "id", "left").join(names, "supermarket_id", "left")
    jobs = F.coalesce("jobs", F.lit(0))
    return w.select("id", "supermarket_id", worker_slug(c("name")).alias("slug"), F.coalesce("market", F.lit("—")).alias("market"), jobs.alias("jobs24h"), (c("ok") / F.nullif(c("jobs"), F.lit(0))).alias("rate"), filters.source_kinds(F.array().cast("array<string>"), c("start_url")).alias("kinds"), F.coalesce("last_run_at", "started").alias("last_run"), filters.ops_status(c("status"), c("last"), jobs).alias("ops"))


@query("worker_overview", f"WITH {cte('flows', 'runs')}, {_RUNS} SELECT id, slug, market, jobs24h, {half('rate', 4)} AS rate, kinds, ops, {day('last_run')} AS last_run FROM workers")
def worker_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each worker: name, market, runs of the day and their success, sources and state."""
    return _workers(spark, sf_dir).select("id", "slug", "market", "jobs24h", half_up(F.col("rate"), 4).alias("rate"), F.array_join("kinds", ",").alias("kinds"), "ops", _stamp("last_run"))


@query("filtered_workers", f"WITH {cte('flows', 'runs')}, {_RUNS} SELECT id FROM workers WHERE kinds = 'html' AND (ops = 'fail' OR (ops <> 'running' AND (last_run IS NULL OR last_run < {_AT} - INTERVAL 1 DAY)) OR coalesce(rate < 0.8, false))")
def filtered_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers that read pages, and failed, are stale or parse badly."""
    w = _workers(spark, sf_dir).select("id", F.col("market").alias("supermarket_name"), "supermarket_id", F.col("kinds").alias("source_kinds"), F.col("ops").alias("status"), F.col("last_run").alias("last_run_at"), F.col("rate").alias("parse_rate"), F.col("jobs24h").alias("jobs_24h"))
    return worker_list(w, _now(AT), sources=["html"], health=["fail", "stale", "low_parse"]).select("id")


@query("attention_sorted", f"WITH {cte('flows', 'runs')}, {_RUNS} SELECT id, ops, severity FROM (SELECT id, ops, CASE ops WHEN 'fail' THEN 0 WHEN 'review' THEN 1 WHEN 'queue' THEN 2 ELSE 3 END AS severity FROM workers) ORDER BY severity, id LIMIT 30")
def attention_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty workers that most need a look, by the rank of their state."""
    rank = F.create_map(*[F.lit(v) for kv in {"fail": 0, "review": 1, "queue": 2, "running": 3}.items() for v in kv])
    return _workers(spark, sf_dir).select("id", "ops", F.try_element_at(rank, F.col("ops")).alias("severity")).orderBy("severity", "id").limit(30)


_LIVE = f"status NOT IN ('expired', 'failed') AND (valid_from IS NULL OR valid_from <= {_NOW}) AND (valid_until IS NULL OR valid_until >= {_NOW})"


@query("automation_rows", f"""WITH {cte('flyers', 'flows', 'runs')}, c AS (SELECT supermarket_id, arg_max(title, (coalesce(valid_until, TIMESTAMP '1970-01-01'), n)) AS title, arg_max(n, (coalesce(valid_until, TIMESTAMP '1970-01-01'), n)) AS n FROM flyers WHERE {_LIVE} GROUP BY 1), l AS (SELECT flow_id, arg_max(coalesce(error, '-'), (started_at, id)) AS err, max(started_at) AS started FROM runs GROUP BY 1)
SELECT f.id, coalesce(s_name, '—') AS market, f.status, {day('coalesce(last_run_at, started)')} AS last_run, discovery_attempts, nullif(err, '-') AS last_error, c.title AS current_title, c.n AS current_id, {day('next_run_at')} AS next_run FROM flows f LEFT JOIN c ON c.supermarket_id = f.supermarket_id LEFT JOIN l ON flow_id = f.id LEFT JOIN supplier ON s_suppkey = f.supermarket_id""")
def automation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with their last run and the live flyer of their market that ends last."""
    c = F.col
    f = frame(spark, sf_dir, "flyers").filter(filters.flyer_current(c("status"), c("valid_from"), c("valid_until"), _now()))
    current = f.groupBy("supermarket_id").agg(F.max_by(F.struct("title", "n"), F.struct(F.coalesce("valid_until", _now("1970-01-01")), "n")).alias("cur"))
    last = frame(spark, sf_dir, "runs").groupBy(c("flow_id").alias("id")).agg(F.max_by("error", F.struct("started_at", "id")).alias("last_error"), F.max("started_at").alias("started"))
    names = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("supermarket_id"), c("s_name").alias("market"))
    rows = frame(spark, sf_dir, "flows").join(current, "supermarket_id", "left").join(last, "id", "left").join(names, "supermarket_id", "left")
    return rows.select("id", F.coalesce("market", F.lit("—")).alias("market"), "status", F.date_format(F.coalesce("last_run_at", "started"), "yyyy-MM-dd HH:mm").alias("last_run"), "discovery_attempts", "last_error", c("cur.title").alias("current_title"), c("cur.n").alias("current_id"), F.date_format("next_run_at", "yyyy-MM-dd HH:mm").alias("next_run"))


@query("automation_counters", f"""WITH {cte('flyers', 'flows')}, a AS (SELECT count(*) FILTER (WHERE status = 'active') AS flows_active, count(*) FILTER (WHERE status = 'error') AS flows_error FROM flows),
b AS (SELECT count(*) FILTER (WHERE {_LIVE}) AS flyers_live, count(*) FILTER (WHERE status = 'expired') AS flyers_expired, count(*) FILTER (WHERE status = 'discovered') AS pending_download, count(*) FILTER (WHERE status IN ('downloaded', 'partially_processed') AND (valid_from IS NULL OR valid_from <= {_NOW} + INTERVAL 24 HOUR)) AS pending_extract FROM flyers) SELECT * FROM a, b""")
def automation_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six counters in two scans."""
    c = F.col
    a = frame(spark, sf_dir, "flows").agg(*[F.count_if(c("status") == s).alias(f"flows_{s}") for s in ("active", "error")])
    b = frame(spark, sf_dir, "flyers").agg(
        F.count_if(filters.flyer_current(c("status"), c("valid_from"), c("valid_until"), _now())).alias("flyers_live"), F.count_if(c("status") == "expired").alias("flyers_expired"),
        F.count_if(c("status") == "discovered").alias("pending_download"), F.count_if(filters.pending_extract(c("status"), c("valid_from"), _now())).alias("pending_extract"),
    )
    return a.crossJoin(F.broadcast(b))


@query("dashboard_metrics", f"""WITH {cte('flyers', 'offers', 'runs')}, s AS (SELECT count(*) AS supermarkets, count(*) FILTER (WHERE s_acctbal > 0) AS active_supermarkets FROM supplier),
f AS (SELECT count(*) FILTER (WHERE status NOT IN ('expired', 'failed') AND (valid_until IS NULL OR valid_until >= {_NOW})) AS active_flyers, count(*) FILTER (WHERE status = 'processed') AS processed_flyers, count(*) FILTER (WHERE status = 'partially_processed') AS partial_flyers, count(*) FILTER (WHERE status = 'expired') AS expired_flyers, count(*) FILTER (WHERE status = 'failed') AS failed_flyers FROM flyers),
o AS (SELECT count(*) AS offers, count(*) FILTER (WHERE validation_status = 'validated') AS validated, count(*) FILTER (WHERE validation_status = 'pending') AS pending, count(*) FILTER (WHERE validation_status = 'rejected') AS rejected, count(*) FILTER (WHERE validation_status = 'suspicious') AS suspicious FROM offers),
e AS (SELECT count(*) FILTER (WHERE event_type = 'error') AS open_errors, count(*) FILTER (WHERE event_type = 'purchase' AND event_id % 2 = 0) AS vision_pages, count(*) FILTER (WHERE event_id % 2 = 1) AS rule_pages, count(*) FILTER (WHERE event_type = 'error') AS failures, coalesce(CAST(floor(avg(value) FILTER (WHERE value > 0) + 0.5) AS BIGINT), 0) AS mean_latency FROM events) SELECT * FROM s, f, o, e""")
def dashboard_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seventeen indicators, one scan a table."""
    c = F.col
    n = lambda cond, name: F.count_if(cond).alias(name)
    s = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("supermarkets"), n(c("s_acctbal") > 0, "active_supermarkets"))
    status = c("status")
    f = frame(spark, sf_dir, "flyers").agg(n(filters.flyer_active(status, c("valid_until"), _now()), "active_flyers"), n(status == "processed", "processed_flyers"), n(status == "partially_processed", "partial_flyers"), n(status == "expired", "expired_flyers"), n(status == "failed", "failed_flyers"))
    o = frame(spark, sf_dir, "offers").agg(F.count(F.lit(1)).alias("offers"), *[n(c("validation_status") == v, v) for v in ("validated", "pending", "rejected", "suspicious")])
    kind, k = c("event_type"), c("event_id")
    e = table(spark, sf_dir, "events").agg(n(kind == "error", "open_errors"), n((kind == "purchase") & (k % 2 == 0), "vision_pages"), n(k % 2 == 1, "rule_pages"), n(kind == "error", "failures"), F.coalesce(F.floor(F.avg(F.when(c("value") > 0, c("value"))) + 0.5), F.lit(0)).cast("bigint").alias("mean_latency"))
    return s.crossJoin(F.broadcast(f)).crossJoin(F.broadcast(o)).crossJoin(F.broadcast(e))  # four rows


@query("recent_flyers", f"WITH {cte('flyers')} SELECT id, title, status, supermarket_id FROM flyers ORDER BY created_at DESC, n DESC LIMIT 8")
def recent_flyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "flyers").orderBy(F.desc("created_at"), F.desc("n")).limit(8).select("id", "title", "status", "supermarket_id")


@query("parse_rate", f"""WITH {cte('flyers')}, c AS (SELECT count(*) FILTER (WHERE status = 'processed') AS parsed, count(*) FILTER (WHERE status IN ('partially_processed', 'downloaded', 'processing')) AS review, count(*) FILTER (WHERE status = 'failed') AS failed FROM flyers WHERE created_at >= {_NOW} - INTERVAL 7 DAY)
SELECT parsed, review, failed, CASE WHEN parsed + review + failed = 0 THEN 0.0 ELSE {half('parsed / (parsed + review + failed)::DOUBLE', 6)} END AS parse_rate FROM c""")
def parse_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the week's flyers that were read whole; 0 without any."""
    f, s = frame(spark, sf_dir, "flyers").filter(F.col("created_at") >= _now() - F.expr("INTERVAL 7 DAYS")), F.col("status")
    c = f.agg(F.count_if(s == "processed").alias("parsed"), F.count_if(s.isin("partially_processed", "downloaded", "processing")).alias("review"), F.count_if(s == "failed").alias("failed"))
    return c.withColumn("parse_rate", F.coalesce(half_up(F.col("parsed") / F.nullif(F.col("parsed") + F.col("review") + F.col("failed"), F.lit(0)), 6), F.lit(0.0)))


@query("week_chart", f"""WITH {cte('runs')}, d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-24', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS d) SELECT strftime(d, '%Y-%m-%d') AS day, CAST(strftime(d, '%-d') AS STRING) AS label, count(id) AS jobs FROM d LEFT JOIN runs ON CAST(started_at AS DATE) = d GROUP BY d""")
def week_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the last seven days, days without any as zero."""
    r = frame(spark, sf_dir, "runs").filter(F.col("started_at") >= _now("2024-01-24")).groupBy(F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("jobs"))
    return calendar(spark, "2024-01-24", 7).join(r, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("day", "d").alias("label"), F.coalesce("jobs", F.lit(0)).alias("jobs"))


@query("year_grid", f"""WITH {cte('runs')}, c AS (SELECT CAST(started_at AS DATE) AS d, count(*) AS n FROM runs GROUP BY 1), r AS (SELECT DATE '2023-02-01' AS first, DATE '2023-02-01' - CAST(dayofweek(DATE '2023-02-01') AS INTEGER) AS sunday)
SELECT strftime(first, '%Y-%m-%d') AS range_start, CAST(date_diff('day', sunday, d - CAST(dayofweek(d) AS INTEGER)) / 7 AS INTEGER) AS col, strftime(d, '%Y-%m-%d') AS day, n, CAST(floor(date_diff('day', sunday, DATE '2024-01-30' - CAST(dayofweek(DATE '2024-01-30') AS INTEGER)) / 7.0) + 1 AS INTEGER) AS weeks,
  (d - CAST(dayofweek(d) AS INTEGER)) + 6 >= DATE '2024-01-10' AND d - CAST(dayofweek(d) AS INTEGER) <= DATE '2024-01-20' AS in_zoom, strftime(date_trunc('quarter', d), '%Y-%m-%d') AS quarter FROM c, r""")
def year_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in a grid of Sunday weeks that begins eleven months back, with a zoomed range and the quarters."""
    c = frame(spark, sf_dir, "runs").groupBy(F.to_date("started_at").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    today, d = F.to_date(F.lit("2024-01-30")), F.col("d")
    first = year_start(today)
    sunday = sunday_week(first)
    weeks = week_count(sunday, today)
    quarter = F.element_at(F.filter(quarter_starts(first, today), lambda q: q <= d), -1)
    return c.select(F.date_format(first, "yyyy-MM-dd").alias("range_start"), week_column(sunday, d, weeks).alias("col"), F.date_format("d", "yyyy-MM-dd").alias("day"), "n", weeks.alias("weeks"), week_overlaps(sunday_week(d), F.to_date(F.lit("2024-01-20")), F.to_date(F.lit("2024-01-10"))).alias("in_zoom"), F.date_format(quarter, "yyyy-MM-dd").alias("quarter"))


@query("rotated_week", f"WITH {cte('runs')}, c AS (SELECT CAST(dayofweek(started_at) AS INTEGER) AS w, count(*) AS n FROM runs GROUP BY 1) SELECT string_agg(CAST(n AS STRING), ',' ORDER BY (w + 6) % 7) AS counts FROM c")
def rotated_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by weekday, beginning with Monday."""
    c = frame(spark, sf_dir, "runs").groupBy((F.dayofweek("started_at") - 1).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    a = c.agg(F.array_sort(F.collect_list(F.struct("w", "n"))).alias("a"))  # seven
    return a.select(F.array_join(F.transform(rotate(F.col("a"), 1), lambda x: x["n"].cast("string")), ",").alias("counts"))


_WINDOW = f"w AS (SELECT r.id, f.supermarket_id AS market, started_at AS b, coalesce(finished_at, {_AT}) + INTERVAL 120 SECOND AS e, r.status FROM runs r JOIN flows f ON f.id = flow_id WHERE r.status = 'running'), o AS (SELECT event_id AS id, user_id % 50 + 1 AS market, ts, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'suspicious' ELSE 'validated' END AS vs FROM events WHERE event_type <> 'purchase')"


def _run_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = F.col
    flows = frame(spark, sf_dir, "flows").select(c("id").alias("flow_id"), c("supermarket_id").alias("market"))
    w = frame(spark, sf_dir, "runs").filter("status = 'running'").join(flows, "flow_id")
    w = w.select("id", "market", c("started_at").cast("timestamp").alias("b"), (F.coalesce("finished_at", _now(AT)) + F.expr("INTERVAL 120 SECONDS")).cast("timestamp").alias("e"), "status")
    k = c("event_id") % 4
    o = table(spark, sf_dir, "events").filter("event_type <> 'purchase'").select("event_id", (c("user_id") % 50 + 1).alias("market"), c("ts").cast("timestamp").alias("ts"), F.when(k == 0, "pending").when(k == 1, "suspicious").otherwise("validated").alias("vs"))
    return w, o


@query("run_offer_range_join", f"""WITH {cte('runs', 'flows')}, {_WINDOW}, j AS (SELECT w.id, count(o.id) AS offers, count(*) FILTER (WHERE vs = 'pending') AS pending, count(*) FILTER (WHERE vs = 'suspicious') AS suspicious FROM w JOIN o ON o.market = w.market AND ts BETWEEN b AND e GROUP BY 1)
SELECT w.id, coalesce(offers, 0) AS offers, coalesce(pending, 0) AS pending, coalesce(suspicious, 0) AS suspicious, CASE WHEN w.id % 10 = 0 THEN 'blocked' WHEN coalesce(suspicious, 0) > 0 THEN 'review' WHEN coalesce(pending, 0) > 0 THEN 'fila' ELSE 'done' END AS queue_state FROM w LEFT JOIN j ON j.id = w.id""")
def run_offer_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers made within each run's interval (to now if it goes on, and two minutes more), and where the run stands; counted along each market's time line."""
    w, o = _run_windows(spark, sf_dir)
    counts = {"offers": F.lit(1), **{v: F.col("vs") == v for v in ("pending", "suspicious")}}
    met = range_counts(range_marks(w, o, "id", "market", "b", "e", "ts", counts), "id", "market", list(counts))
    out = w.select("id").join(met, "id", "left").fillna(0, ["offers", "pending", "suspicious"])
    return out.withColumn("queue_state", filters.run_queue(F.when(F.col("id") % 10 == 0, "failed").otherwise("success"), F.col("suspicious"), F.col("pending")))


@query("run_flyers", f"""WITH {cte('runs', 'flows')}, {_WINDOW}, f AS (SELECT event_id AS id, user_id % 50 + 1 AS market, CASE WHEN event_id % 40 = 0 THEN ts END AS c, CASE WHEN event_id % 60 = 0 THEN ts + INTERVAL 5 HOUR END AS u FROM events), n AS (SELECT (event_id // 40) * 40 AS flyer, market, o.ts FROM o JOIN events ON event_id = o.id),
d AS (SELECT DISTINCT w.id AS run_id, f.id AS flyer_id FROM w JOIN f ON f.market = w.market AND (c BETWEEN b AND e OR u BETWEEN b AND e)) SELECT * FROM d UNION ALL SELECT DISTINCT w.id, flyer FROM w JOIN n ON n.market = w.market AND ts BETWEEN b AND e WHERE w.id NOT IN (SELECT run_id FROM d)""")
def run_flyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flyers that a run touched, or those that got offers while it ran."""
    w, o = _run_windows(spark, sf_dir)
    made = F.col("ts").cast("timestamp")
    f = table(spark, sf_dir, "events").select(F.col("event_id").alias("flyer_id"), (F.col("user_id") % 50 + 1).alias("market"), F.when(F.col("event_id") % 40 == 0, made).alias("created_at"), F.when(F.col("event_id") % 60 == 0, made + F.expr("INTERVAL 5 HOURS")).alias("updated_at"))
    offers = o.select((F.floor(F.col("event_id") / 40) * 40).alias("flyer_id"), "market", F.col("ts").alias("created_at"))
    return touched_or_filled(w.select(F.col("id").alias("run_id"), "market", F.col("b").alias("begin"), F.col("e").alias("end")), f, offers)


@query("run_outcomes", f"WITH {cte('runs')} SELECT id, CASE WHEN error = 'cancelled' THEN 'cancelled' WHEN status <> 'failed' AND id % 5 > 0 AND id % 3 = 0 THEN 'duplicate' WHEN status <> 'failed' THEN 'success' ELSE 'failed' END AS outcome FROM runs")
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col, F.col("id")
    return frame(spark, sf_dir, "runs").select("id", filters.run_outcome(c("error"), c("status") != "failed", k % 5, k % 3).alias("outcome"))


@query("x_domain", f"WITH {cte('runs')}, r AS (SELECT * FROM runs WHERE started_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12') SELECT {day('min(started_at)')} AS low, {day('greatest(max(started_at), TIMESTAMP ' + chr(39) + '2024-02-01' + chr(39) + ')')} AS high, count(*) AS n FROM r")
def x_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a range given in either order; the brush's extent goes on to a later end."""
    r = frame(spark, sf_dir, "runs").filter(filters.in_x_domain(F.col("started_at"), _now("2024-01-12"), _now("2024-01-10")))
    e = r.agg(F.min("started_at").alias("low"), F.greatest(F.max("started_at"), _now("2024-02-01")).alias("high"), F.count(F.lit(1)).alias("n"))
    return e.select(_stamp("low"), _stamp("high"), "n")


@query("denied_finds", f"WITH {cte('flyers')} SELECT id FROM flyers WHERE lower(original_url) NOT IN (SELECT lower('HTTPS://shop.example/' || CAST(n AS STRING)) FROM flyers WHERE n % 3 = 0) AND lower(title) NOT IN ('5-low')")
def denied_finds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds whose address or title is on no list of what is to be skipped."""
    f = frame(spark, sf_dir, "flyers")
    denied = f.filter("n % 3 = 0").select(F.concat(F.lit("HTTPS://shop.example/"), F.col("n").cast("string")).alias("key")).union(f.sparkSession.createDataFrame([("5-LOW",)], "key string"))
    return without_denied(f.withColumn("url", F.col("original_url")), denied).select("id")


@query("identity_lookup", f"WITH {cte('flyers')}, k AS (SELECT * FROM flyers WHERE valid_from IS NOT NULL AND valid_until IS NOT NULL ORDER BY n LIMIT 1) SELECT f.id, f.title FROM flyers f JOIN k ON f.supermarket_id = k.supermarket_id AND f.source_id = k.source_id AND f.valid_from = k.valid_from AND f.valid_until = k.valid_until AND f.n = k.n")
def identity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one flyer of a market, source and window; two are an error."""
    f = frame(spark, sf_dir, "flyers")
    key = ["supermarket_id", "source_id", "valid_from", "valid_until", "n"]
    k = f.filter("valid_from IS NOT NULL AND valid_until IS NOT NULL").orderBy("n").limit(1).select(*key)
    return unique_row(f.join(F.broadcast(k), key, "left_semi"), "flyer of an identity").select("id", "title")


@query("market_list", f"""WITH {cte('flyers', 'offers')}, a AS (SELECT supermarket_id, count(*) AS flyers, count(DISTINCT source_id) AS sources, arg_max(n, (valid_until, n)) FILTER (WHERE {_LIVE} AND valid_until IS NOT NULL) AS active_flyer FROM flyers GROUP BY 1), o AS (SELECT supermarket_id, count(*) AS offers FROM offers GROUP BY 1), c AS (SELECT c_nationkey, count(*) AS stores FROM customer GROUP BY 1)
SELECT s_suppkey AS market, s_name AS name, coalesce(stores, 0) AS stores, coalesce(sources, 0) AS sources, coalesce(flyers, 0) AS flyers, coalesce(offers, 0) AS offers, active_flyer FROM supplier LEFT JOIN a ON a.supermarket_id = s_suppkey LEFT JOIN o ON o.supermarket_id = s_suppkey LEFT JOIN c ON c_nationkey = s_nationkey""")
def market_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets with their stores, sources, flyers and offers, and the live flyer that ends last."""
    c = F.col
    live = filters.flyer_current(c("status"), c("valid_from"), c("valid_until"), _now())
    a = frame(spark, sf_dir, "flyers").groupBy(c("supermarket_id").alias("market")).agg(F.count(F.lit(1)).alias("flyers"), F.count_distinct("source_id").alias("sources"), F.max_by("n", F.when(live & c("valid_until").isNotNull(), F.struct("valid_until", "n"))).alias("active_flyer"))
    o = frame(spark, sf_dir, "offers").groupBy(c("supermarket_id").alias("market")).agg(F.count(F.lit(1)).alias("offers"))
    stores = table(spark, sf_dir, "customer").groupBy(c("c_nationkey").alias("s_nationkey")).agg(F.count(F.lit(1)).alias("stores"))
    s = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("market"), c("s_name").alias("name"), "s_nationkey")
    return s.join(a, "market", "left").join(o, "market", "left").join(stores, "s_nationkey", "left").select("market", "name", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("stores", "sources", "flyers", "offers")], "active_flyer")
