"""Streams that keep state: a flow's schedule, retention of evidence, idempotent answers, sliding indicators, runs with their offers."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pricewell.operators.lifecycle import ATTEMPTS, RECHECK_HOURS
from pricewell.sources.scratch import new_folder
from pricewell.sources.sinks import _fs

STEP = "id string, at timestamp, attempts int, status string, next_run_at timestamp, message string, kind string"


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def state_store(spark: SparkSession, provider: str = ROCKS):
    """Streams started inside keep their state in RocksDB, which state machines need and large state wants."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, provider)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def finish(stream: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """All that is there now, run to its end, as a table.

    Without ``keys`` rows are appended. With them the stream updates its rows: each micro-batch is stored under its number, so a repeated one
    replaces itself, and of a key the row of the latest batch counts.
    """
    spark, folder = stream.sparkSession, new_folder(stream.sparkSession, name)
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if keys is None:
        with state_store(spark):
            writer.outputMode("append").format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    with state_store(spark):
        writer.outputMode("update").foreachBatch(store).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("_r")).select("_r.*")


def _ms(x: datetime) -> int:
    """Milliseconds of an instant; session and worker tell time in the same zone."""
    return int(x.timestamp() * 1000)


class FlowMachine(StatefulProcessor):
    """One flow: its attempts, status and next run; a timer tells when the next run is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", "status string, attempts int, next_run_at timestamp")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._keep(initialState.status, initialState.discovery_attempts or 0, initialState.next_run_at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, attempts, plan = tuple(self.flow.get()) if self.flow.exists() else ("active", 0, None)
        for r in sorted(rows, key=lambda r: (r.at, r.tie)):
            message, lost = None, not r.ok and "SCOPE_NOT_FOUND" in r.error
            if r.ok:
                attempts, plan = 0, plan if r.new_flyers > 0 else r.at + timedelta(hours=RECHECK_HOURS)
            elif lost:
                message = r.error if status != "error" else None
                attempts, status = ATTEMPTS, "error"
            else:
                attempts += 1
                plan = r.at + timedelta(hours=min(8, 2 ** (attempts - 1)))
                if attempts >= ATTEMPTS:
                    status, message = "error", r.error or f"Discovery failed after {attempts} attempts"
            yield Row(id=key[0], at=r.at, attempts=attempts, status=status, next_run_at=plan, message=message, kind="result")
        self._keep(status, attempts, plan)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, attempts, plan = tuple(self.flow.get())
        if status == "active" and plan is not None:
            yield Row(id=key[0], at=plan, attempts=attempts, status=status, next_run_at=plan, message=None, kind="due")

    def _keep(self, status, attempts, plan) -> None:
        """The new state, and one timer at the most."""
        self.flow.update((status, attempts, plan))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if plan is not None and status == "active":
            self.handle.registerTimer(_ms(plan))

    def close(self) -> None:
        pass


def flow_steps(results: DataFrame, flows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each result's state of its flow as it comes (kind ``result``), and a row when a flow's next run is due (kind ``due``).

    The rules are those of ``operators.lifecycle.run_steps``, which gives the same rows for results at rest. ``flows`` are the states to begin with.
    """
    r = results.select(F.col("id").cast("string").alias("id"), "at", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("new_flyers", F.lit(0)).alias("new_flyers"), F.coalesce("error", F.lit("")).alias("error"))
    r = r.withColumn("tie", F.xxhash64("ok", "new_flyers", "error")).withWatermark("at", late)
    begin = flows.select(F.col("id").cast("string").alias("id"), "status", "discovery_attempts", F.col("next_run_at").cast("timestamp").alias("next_run_at")).groupBy("id")
    return r.groupBy("id").transformWithState(FlowMachine(), STEP, "Append", "EventTime", begin)


class Evidence(StatefulProcessor):
    """One flyer's evidence: kept until so long after its validity has ended, then released with its state."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "pages int, valid_until timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        pages, until = tuple(self.kept.get()) if self.kept.exists() else (0, None)
        for r in rows:
            pages += 1
            until = r.valid_until if until is None else max(until, r.valid_until)
        self.kept.update((pages, until))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(_ms(until + timedelta(days=self.days)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        pages, until = tuple(self.kept.get())
        self.kept.clear()
        yield Row(flyer_id=key[0], pages=pages, valid_until=until)

    def close(self) -> None:
        pass


def released_evidence(pages: DataFrame, days: int = 30, late: str = "1 hour") -> DataFrame:
    """(flyer_id, pages, valid_until) of each flyer as its retention ends; its state goes at the same time.

    ``pages``: flyer_id, at and valid_until. Time is that of the stream: what the watermark has passed is over.
    """
    p = pages.select(F.col("flyer_id").cast("string").alias("flyer_id"), "at", "valid_until").withWatermark("at", late)
    return p.groupBy("flyer_id").transformWithState(Evidence(days), "flyer_id string, pages int, valid_until timestamp", "Append", "EventTime")


def completed_once(answers: DataFrame, within: str = "30 days") -> DataFrame:
    """The first completed answer of each page, model and prompt; replays within that time add no row, also after a restart."""
    done = answers.filter("status = 'completed'").withWatermark("at", within)
    return done.dropDuplicatesWithinWatermark(["page_id", "model", "prompt_version"])


def weekly(events: DataFrame, ts: str, kind: Column, late: str = "1 day") -> DataFrame:
    """(day, kind, n): rows of the seven days before each day's beginning; windows that the watermark has passed are dropped from state."""
    at = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    w = at.groupBy(F.window("_at", "7 days", "1 day").alias("w"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.end").alias("day"), "kind", "n")


def runs_with_offers(runs: DataFrame, offers: DataFrame, late: str = "1 hour", longest: str = "2 hours") -> DataFrame:
    """(run_id, offer_id, status): offers made while a run went on, and a row without one for runs that got none.

    ``runs``: run_id, market, begin, end; ``offers``: offer_id, market, ts, status. Both sides have watermarks and a run lasts ``longest`` at most,
    so Spark knows when a row can meet no other and drops it from state.
    """
    r = runs.select("run_id", F.col("market").alias("_market"), "begin", "end").withWatermark("begin", late)
    o = offers.select("offer_id", "market", "ts", "status").withWatermark("ts", late)
    within = (F.col("market") == F.col("_market")) & (F.col("ts") >= F.col("begin")) & (F.col("ts") <= F.col("end")) & (F.col("ts") <= F.col("begin") + F.expr(f"INTERVAL {longest}"))
    return r.join(o, within, "leftOuter").select("run_id", "offer_id", "status")


def table_stream(spark: SparkSession, sf_dir: str, name: str, files: int = 1) -> DataFrame:
    """A table's files as a stream; a table that is one file is told by its name in the folder."""
    path = f"{sf_dir}/{name}.parquet"
    fs, p = _fs(spark, path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    return reader.parquet(path) if fs.getFileStatus(p).isDirectory() else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
