import time

from pyspark.sql import functions as F

from kelpforge.streaming import jobs, state


def run(spark, frame, folder, until):
    """Runs the stream until ``until`` holds of its output, then stops it; timers keep such a stream awake for ever."""
    query = frame.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(processingTime="100 milliseconds").start()
    rows, deadline = [], time.time() + 120
    try:
        while not until(rows) and time.time() < deadline and query.isActive:
            time.sleep(0.3)
            rows = spark.read.schema(frame.schema).parquet(f"{folder}/out").collect()
    finally:
        query.stop()
    assert until(rows), (rows, query.exception())
    return rows


def test_windows_go_on_over_batches_and_restarts(spark, tmp_path):
    rows = [(u, e, 1_700_000_000 + 7 * e + u) for e in range(60) for u in (1, 2, 3) if (e * u) % 5]
    whole = spark.createDataFrame([(u, 10 * e + u, s) for u, e, s in rows], "user_id long, event_id long, s long").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
    (tmp_path / "out").mkdir()
    n = 0
    for k in range(3):  # each batch a span of time, its rows shuffled, each run a restart from the checkpoint
        part = whole.where(f"event_id BETWEEN {200 * k} AND {200 * k + 199}")
        part.orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        n += part.count()
        stream = spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in"))
        got = run(spark, state.rate_limited_stream(stream, 3, 60), str(tmp_path), lambda x, n=n: len(x) >= n)
    want = sorted(tuple(r) for r in jobs.rate_limited(whole, 3, 60).collect())
    assert sorted(tuple(r) for r in got) == want and 0 < sum(not x[3] for x in want) < len(want)


def test_stuck_jobs_are_queued_again_and_then_fail(spark, tmp_path):
    schema = "job_key string, status string, at long"
    (tmp_path / "out").mkdir()
    rows = [("a", "queued", 1), ("b", "queued", 1), ("b", "succeeded", 2), ("c", "running", 1), ("d", "running", 1), ("d", "retrying", 2)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = run(spark, state.watched_jobs(stream, 0.2, 1), str(tmp_path), lambda x: len(x) >= 4)
    assert sorted(tuple(r) for r in got) == [("a", "fail", 2), ("a", "requeue", 1), ("d", "fail", 2), ("d", "requeue", 1)]


def test_a_restart_keeps_the_wait(spark, tmp_path):
    schema = "job_key string, status string, at long"
    (tmp_path / "out").mkdir()

    def feed(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return state.watched_jobs(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 1.0, 3)

    first = run(spark, feed(("a", "queued", 1), ("b", "queued", 1)), str(tmp_path), lambda x: {(r.job_key, r.attempts) for r in x} >= {("a", 1), ("b", 1)})
    again = run(spark, feed(("a", "succeeded", 2)), str(tmp_path), lambda x: ("b", "fail", 4) in [tuple(r) for r in x])
    assert len(again) > len(first) and [tuple(r) for r in again].count(("b", "fail", 4)) == 1 and not any(r.job_key == "a" and r.action == "fail" for r in again)
