"""State over several micro-batches: timers, retention, replays after a restart, runs without offers."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pricewell.operators import lifecycle
from pricewell.streaming import state

T0 = datetime(2024, 6, 1)
hours = lambda n: T0 + timedelta(hours=n)


def put(spark, rows, schema, path):
    """One more file for a stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(stream, out, check):
    """All new files, one a micro-batch; what the sink holds afterwards, and the query's last progress."""
    with state.state_store(stream.sparkSession):
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out).collect(), q.lastProgress


def read(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


RESULT = "id string, at timestamp, ok boolean, new_flyers int, error string"


def test_machine_and_batch_agree_and_timers_fire(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    flows = spark.createDataFrame([("a", "m", "active", None, None, 0), ("b", "m", "active", None, None, 3), ("c", "m", "active", hours(1), None, 0)], "id string, supermarket_id string, status string, next_run_at timestamp, last_run_at timestamp, discovery_attempts int")
    rows = [[("a", hours(0), True, 0, None), ("b", hours(0), False, 0, "HTTP 500"), ("a", hours(1), False, 0, None)], [("a", hours(2), True, 3, None), ("new", hours(40), True, 1, None), ("b", hours(40), True, 0, None)], [("new", hours(80), False, 0, "SCOPE_NOT_FOUND")]]
    for part in rows:
        put(spark, part, RESULT, src)
    got, _ = run(state.flow_steps(read(spark, src, RESULT), flows), out, check)
    steps = {(r.id, r.at): (r.attempts, r.status, r.next_run_at, r.message) for r in got if r.kind == "result"}
    known = flows.unionByName(spark.createDataFrame([("new", "m", "active", None, None, 0)], flows.schema))
    batch = lifecycle.run_steps(known, spark.createDataFrame([r for part in rows for r in part], RESULT)).collect()
    assert steps == {(r.id, r.at): (r.attempts, r.status, r.next_run_at, r.message) for r in batch} and len(steps) == 7
    # a was next due two hours after its failure at 1; b is in error and is not due
    due = {(r.id, r.at) for r in got if r.kind == "due"}
    assert ("a", hours(2)) in due and ("c", hours(1)) in due and not any(i == "b" for i, _ in due)


PAGE = "flyer_id string, at timestamp, valid_until timestamp"


def test_evidence_goes_after_its_retention(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    day = lambda n: T0 + timedelta(days=n)
    stream = lambda: state.released_evidence(read(spark, src, PAGE))
    put(spark, [("a", day(0), day(5)), ("a", day(0), day(3)), ("b", day(1), day(20))], PAGE, src)
    got, progress = run(stream(), out, check)
    assert got == [] and progress.stateOperators[0].numRowsTotal >= 2
    before = progress.stateOperators[0].numRowsTotal
    put(spark, [("c", day(36), day(90))], PAGE, src)
    got, progress = run(stream(), out, check)
    assert [(r.flyer_id, r.pages, r.valid_until) for r in got] == [("a", 2, day(5))]
    put(spark, [("d", day(51), day(60))], PAGE, src)
    got, progress = run(stream(), out, check)
    assert sorted((r.flyer_id, r.pages) for r in got) == [("a", 2), ("b", 1)]
    assert progress.stateOperators[0].numRowsTotal <= before + 2  # c and d alone are left


ANSWER = "at timestamp, page_id long, model string, prompt_version string, status string"


def test_replayed_files_add_no_row_after_a_restart(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = [(hours(0), 1, "m", "v1", "completed"), (hours(0), 1, "m", "v1", "completed"), (hours(0), 1, "m", "v2", "completed"), (hours(0), 2, "m", "v1", "failed")]
    stream = lambda: state.completed_once(read(spark, src, ANSWER))
    put(spark, rows, ANSWER, src)
    assert len(run(stream(), out, check)[0]) == 2
    put(spark, rows, ANSWER, src)
    put(spark, [(hours(5), 2, "m", "v1", "completed")], ANSWER, src)
    got, _ = run(stream(), out, check)
    assert sorted((r.page_id, r.prompt_version) for r in got) == [(1, "v1"), (1, "v2"), (2, "v1")]


def test_weeks_slide_by_a_day(spark, tmp_path):
    src = str(tmp_path / "in")
    for d in (0, 1, 6, 8):
        put(spark, [(T0 + timedelta(days=d, hours=3), "x")], "ts timestamp, kind string", src)
    got = {r.day: r.n for r in state.finish(state.weekly(read(spark, src, "ts timestamp, kind string"), "ts", F.col("kind")), "w", ["day", "kind"]).collect()}
    want = {}
    for d in (0, 1, 6, 8):
        for k in range(1, 8):
            want[T0 + timedelta(days=d + k)] = want.get(T0 + timedelta(days=d + k), 0) + 1
    assert got == want


def test_runs_without_offers_come_out_too(spark, tmp_path):
    runs, offers, out, check = (str(tmp_path / x) for x in ("r", "o", "out", "check"))
    run_schema, offer_schema = "run_id long, market long, begin timestamp, end timestamp", "offer_id long, market long, ts timestamp, status string"
    put(spark, [(1, 1, hours(0), hours(1)), (2, 2, hours(0), hours(1)), (3, 1, hours(30), hours(31))], run_schema, runs)
    put(spark, [(10, 1, hours(1), "pending"), (11, 1, hours(1) + timedelta(seconds=1), "pending"), (12, 2, hours(0) - timedelta(seconds=1), "x"), (13, 9, hours(30), "x")], offer_schema, offers)
    stream = state.runs_with_offers(read(spark, runs, run_schema), read(spark, offers, offer_schema))
    got, _ = run(stream, out, check)
    assert sorted((r.run_id, r.offer_id) for r in got if r.run_id < 3) == [(1, 10), (2, None)]


def test_runs_count_offers_of_files_that_come_late(spark, tmp_path):
    """The older half of the events comes in the second file: nothing of it is lost to a watermark."""
    from oracle import connect, same

    from pricewell.registry import ORACLES, QUERIES

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    middle = events.approxQuantile("event_id", [0.5], 0.0)[0]
    for half in (F.col("event_id") > middle, F.col("event_id") <= middle):
        events.filter(half).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    con = connect("/root/testdata/sf0.001")
    assert same(QUERIES["streamed_run_offers"](spark, str(tmp_path)), con, ORACLES["streamed_run_offers"]) > 0
