"""Streams batch by batch: late rows, windows that close, state that goes; appends with a ledger."""

import datetime as dt
import math

from pyspark.sql import functions as F

from lodestat.plans import serving_queries
from lodestat.sources import files
from lodestat.streaming import jobs

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "id long, key string, at timestamp, value double, flag boolean"


def row(i, key, hours, value, flag=False):
    return (i, key, DAY + dt.timedelta(hours=hours), float(value), flag)


def played(spark, tmp_path, batches, make):
    """Feeds one file a batch; gives the rows written after each and the late rows that were dropped."""
    got, dropped = [], 0
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{i}")
        source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
        q = make(source).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start()
        q.awaitTermination()
        dropped += sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
        got.append(sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) if i else None)
    return got, dropped


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    batches = [[row(1, "a", 1, 1, True), row(2, "a", 2, 1)], [row(3, "a", 30, 1)], [row(4, "a", 3, 1, True), row(5, "a", 31, 1)], [row(6, "a", 200, 1)]]
    got, dropped = played(spark, tmp_path, batches, lambda s: jobs.gate_monitor(s, "at", "1 hour", "1 day", F.col("flag"), 0.1).select("start", "k", "n"))
    start = lambda x: x[0].astimezone(dt.timezone.utc).replace(tzinfo=None)
    assert [(x[1], x[2]) for x in got[1]] == [(1, 2)]  # the first day has closed
    assert sorted((x[1], x[2]) for x in got[3]) == [(0, 2), (1, 2)] and len({start(x) for x in got[3]}) == 2
    assert dropped == 1  # the row of the first day that came in the third batch


def test_state_goes_after_idle_time(spark, tmp_path):
    hour = 3_600_000
    batches = [[row(1, "a", 1, 10), row(2, "b", 1, 10)], [row(3, "a", 2, 15)], [row(4, "b", 100, 50)], [row(5, "c", 101, 1)], [row(6, "a", 102, 40), row(7, "b", 102, 60)]]
    got, _ = played(spark, tmp_path, batches, lambda s: jobs.counter_growth(s, "key", "value", "1 hour", 24 * hour))
    total = lambda rows, key: sum(g for k, _, g in rows if k == key)
    assert total(got[1], "a") == 5.0
    # a was forgotten: its 40 is a first value again; b was seen two hours before
    assert total(got[4], "a") == 5.0 and total(got[4], "b") >= 10.0


def test_append_reads_only_ranges_that_meet(spark, tmp_path):
    path = f"{tmp_path}/rows"
    assert files.appended(spark, path) is None
    assert files.append_missing(spark.range(0, 100), path, "id") == 100
    assert files.append_missing(spark.range(100, 200), path, "id") == 100
    assert files.append_missing(spark.range(150, 260), path, "id") == 60
    assert files.append_missing(spark.range(0), path, "id") == 0 and files.append_missing(spark.range(20, 30), path, "id") == 0
    assert sorted(r["id"] for r in files.appended(spark, path).collect()) == list(range(260))
    ledger = sorted((r["low"]["id"], r["high"]["id"], r["n"]) for r in files.ledger_of(spark, path).collect())
    assert ledger == [(0, 99, 100), (100, 199, 100), (200, 259, 60)]
    # what a lost run left without a ledger row does not count
    spark.range(900, 950).write.parquet(f"{path}/append=lost")
    assert files.appended(spark, path).count() == 260 and files.append_missing(spark.range(900, 901), path, "id") == 1
    # the files of appends out of range are not opened
    first = next(r["append"] for r in files.ledger_of(spark, path).collect() if r["low"]["id"] == 0)
    (tmp_path / "rows" / f"append={first}").rename(tmp_path / "gone")
    assert files.append_missing(spark.range(255, 270), path, "id") == 10


def test_load_profile_of_a_large_window_is_exact(spark, tmp_path):
    n = 70_000
    hours = F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, id % 11)")
    rows = spark.range(n).select(F.col("id").alias("event_id"), hours.alias("ts"), F.when(F.col("id") % 10 == 3, None).otherwise(F.sqrt("id") * 7).alias("value"))
    rows.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["start"]: (r["n"], r["p50"], r["p95"]) for r in serving_queries.stream_load_profile(spark, str(tmp_path)).collect()}
    want = {}
    for start in (0, 6):
        own = [i for i in range(n) if i % 11 // 6 * 6 == start]
        values = sorted(math.sqrt(i) * 7 for i in own if i % 10 != 3)
        want[DAY + dt.timedelta(hours=start)] = (len(own), values[-(-len(values) * 50 // 100) - 1], values[-(-len(values) * 95 // 100) - 1])
    assert got == want
