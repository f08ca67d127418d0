"""Jobs as streams: idempotent intake, latest states, and rate limits anchored at the first request."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allowed(times: list[float], limit: int, seconds: int) -> list[bool]:
    """Whether each of the ordered times is let through: a window opens at its first request and holds ``limit``."""
    out, opened, used = [], None, 0
    for t in times:
        if opened is None or t - opened >= seconds:
            opened, used = t, 0
        used += 1
        out.append(used <= limit)
    return out


def rate_limited(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """``user_id, event_id, ts, allowed``: each identity's requests in order of time, in windows of its own.

    Requests are sorted within partitions and streamed through, so that a busy identity is never gathered.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, opened, used = None, None, 0
        for frame in frames:
            flags = []
            for u, t in zip(frame["user_id"], frame["ts"].astype("int64") / 1e9, strict=True):
                if u != user or t - opened >= seconds:
                    user, opened, used = u, t, 0
                used += 1
                flags.append(used <= limit)
            yield frame.assign(allowed=flags)

    ordered = requests.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return ordered.mapInPandas(run, "user_id long, event_id long, ts timestamp, allowed boolean")


def distinct_jobs(jobs: DataFrame, key: str = "idempotency_key", at: str = "created_at", late: str = "1 hour") -> DataFrame:
    """A stream of jobs, each key once within the watermark."""
    return jobs.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def process(jobs: DataFrame, handle: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Runs ``handle`` over micro-batches; its rows replace those of a batch that is run again.

    A failed job is a row with a status and a reason, never an exception.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        handle(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return jobs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
