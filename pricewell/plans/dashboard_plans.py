"""Operations over the run and event log: daily series, worker states, heatmap, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewell.functions.dates import calendar, heat_level, sunday_week
from pricewell.functions.semantics import half_up, ratio_pct
from pricewell.operators.filters import ops_status
from pricewell.registry import query
from pricewell.sources.tables import table

FIRST, DAYS, NOW = "2024-01-01", 30, "2024-01-31"
_DAYS_SQL = "days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS d)"


def _ntz(x: str):
    return F.lit(x).cast("timestamp_ntz")


@query(
    "match_timeseries",
    f"""WITH {_DAYS_SQL}, c AS (SELECT CAST(ts AS DATE) AS d, count(*) FILTER (WHERE value > 50) AS matched, count(*) FILTER (WHERE value IS NULL OR value <= 50) AS unmatched FROM events GROUP BY 1),
g AS (SELECT d, coalesce(matched, 0) AS matched, coalesce(unmatched, 0) AS unmatched FROM days LEFT JOIN c USING (d))
SELECT strftime(d, '%Y-%m-%d') AS day, matched, unmatched,
  CAST(sum(matched + unmatched) OVER (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS week,
  CAST(coalesce(sum(matched + unmatched) OVER (ORDER BY d ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING), 0) AS BIGINT) AS previous_week FROM g""",
)
def match_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched and unmatched rows a day, with this week's total and the last one's. The window runs over 30 rows."""
    hit = F.coalesce(F.col("value") > 50, F.lit(False))
    c = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unmatched"))
    g = calendar(spark, FIRST, DAYS).join(c, "day", "left").fillna(0, ["matched", "unmatched"])
    w, total = Window.orderBy("day"), F.col("matched") + F.col("unmatched")
    return g.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "matched", "unmatched", F.sum(total).over(w.rowsBetween(-6, 0)).alias("week"), F.coalesce(F.sum(total).over(w.rowsBetween(-13, -7)), F.lit(0)).alias("previous_week"))


@query(
    "ops_overview",
    f"""SELECT count(*) AS runs, count(*) FILTER (WHERE event_type = 'purchase') AS ok,
  CAST(floor(count(*) FILTER (WHERE event_type = 'purchase') / greatest(count(*), 1) * 100 * 10.0 + 0.5) AS DOUBLE) / 10.0 AS success_pct,
  count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS week, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24') AS previous_week,
  CAST(floor((count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') - count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24')) / nullif(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24'), 0) * 100 * 10.0 + 0.5) AS DOUBLE) / 10.0 AS delta_pct,
  coalesce(CAST(floor(avg(value) FILTER (WHERE value > 0) + 0.5) AS DOUBLE), 0) AS mean_positive, count(DISTINCT user_id) AS workers FROM events WHERE ts < TIMESTAMP '{NOW}'""",
)
def ops_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar indicators in one scan of conditional aggregates."""
    e = table(spark, sf_dir, "events").filter(F.col("ts") < _ntz(NOW))
    week, prev = F.col("ts") >= _ntz("2024-01-24"), (F.col("ts") >= _ntz("2024-01-17")) & (F.col("ts") < _ntz("2024-01-24"))
    a = e.agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("event_type") == "purchase").alias("ok"), F.count_if(week).alias("week"), F.count_if(prev).alias("previous_week"), F.avg(F.when(F.col("value") > 0, F.col("value"))).alias("m"), F.count_distinct("user_id").alias("workers"))
    return a.select("runs", "ok", ratio_pct(F.col("ok"), F.col("runs")).alias("success_pct"), "week", "previous_week", half_up((F.col("week") - F.col("previous_week")) / F.nullif(F.col("previous_week"), F.lit(0)) * 100, 1).alias("delta_pct"), F.coalesce(half_up(F.col("m")), F.lit(0.0)).alias("mean_positive"), "workers")


@query(
    "worker_rows",
    f"""WITH l AS (SELECT user_id, count(*) AS runs, arg_max(event_type, (ts, event_id)) AS last_status, max(ts) AS last_ts, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '{NOW}') AS jobs_24h FROM events GROUP BY user_id)
SELECT user_id, runs, last_status, strftime(last_ts, '%Y-%m-%d') AS last_day, jobs_24h,
  CASE WHEN user_id % 7 = 0 THEN 'fail' WHEN last_status = 'signup' THEN 'queue' WHEN last_status = 'error' THEN 'fail' WHEN last_status = 'purchase' THEN 'running' WHEN last_status = 'view' OR user_id % 11 = 0 THEN 'review' WHEN jobs_24h > 0 THEN 'running' ELSE 'queue' END AS ops_status FROM l""",
)
def worker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each worker with its last run and its state by fixed priority."""
    e = table(spark, sf_dir, "events")
    day = (F.col("ts") >= _ntz("2024-01-30")) & (F.col("ts") < _ntz(NOW))
    rows = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_status"), F.max("ts").alias("last_ts"), F.count_if(day).alias("jobs_24h"))
    flow = F.when(F.col("user_id") % 7 == 0, "error").when(F.col("user_id") % 11 == 0, "testing").otherwise("active")
    kind = F.col("last_status")
    last = F.when(kind == "purchase", "running").when(kind == "error", "failed").when(kind == "signup", "cancelled").when(kind == "view", "partial").otherwise("success")
    return rows.select("user_id", "runs", "last_status", F.date_format("last_ts", "yyyy-MM-dd").alias("last_day"), "jobs_24h", ops_status(flow, last, F.col("jobs_24h")).alias("ops_status"))


@query(
    "run_heatmap",
    """WITH c AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS running, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS day, strftime(d - CAST(dayofweek(d) AS INTEGER), '%Y-%m-%d') AS week, n, running, kinds, CAST(least(n, 4) AS INTEGER) AS level FROM c""",
)
def run_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs a day with their kinds, the Sunday of the week and the heat level."""
    c = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("running"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))
    return c.select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.date_format(sunday_week(F.col("d")), "yyyy-MM-dd").alias("week"), "n", "running", "kinds", heat_level(F.col("n")).alias("level"))


@query(
    "event_mode",
    "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, event_type AS most_common, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1",
)
def event_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority vote for each key; of equally frequent values the first seen."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("f"))
    best = c.groupBy("user_id").agg(F.max_by(F.struct("event_type", "n"), F.struct("n", (-F.col("f")).alias("f"))).alias("r"))
    return best.select("user_id", F.col("r.event_type").alias("most_common"), F.col("r.n").alias("n"))


@query(
    "event_props",
    """SELECT event_type, count(*) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS pages, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) AS without_page FROM events GROUP BY event_type""",
)
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text read with a path."""
    page = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(page).alias("pages"), F.count_if(page.isNull()).alias("without_page"))


@query(
    "attention_items",
    f"""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_status, max(ts) AS last_ts FROM events GROUP BY user_id)
SELECT user_id, 'failed' AS reason, 0 AS severity FROM l WHERE last_status = 'error'
UNION ALL SELECT user_id, 'stale', 1 FROM l WHERE last_ts < TIMESTAMP '{NOW}' - INTERVAL 72 HOUR
UNION ALL SELECT user_id, 'purchase', 2 FROM l WHERE last_status = 'purchase'""",
)
def attention_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What needs a look, with a severity rank; one scan feeds all three lists."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_status"), F.max("ts").alias("last_ts"))
    stale = F.col("last_ts") < _ntz(NOW) - F.expr("INTERVAL 72 HOURS")
    item = lambda cond, reason, rank: F.when(cond, F.struct(F.lit(reason).alias("reason"), F.lit(rank).alias("severity")))
    items = F.filter(F.array(item(F.col("last_status") == "error", "failed", 0), item(stale, "stale", 1), item(F.col("last_status") == "purchase", "purchase", 2)), lambda x: x.isNotNull())
    return last.select("user_id", F.explode(items).alias("i")).select("user_id", "i.reason", "i.severity")
