"""Operators with state that outlives a micro-batch, and timers that act when nothing arrives.

Both keep one small value a key and drop it when its time is over, so that the state holds the keys of the last while, not
all that ever came. A restart from the checkpoint goes on with state and timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALLOWED = "user_id long, event_id long, ts timestamp, allowed boolean"
ACTIONS = "job_key string, action string, attempts long"


def rate_limited_stream(requests: DataFrame, limit: int, seconds: float, idle: float = 3600.0) -> DataFrame:
    """``user_id, event_id, ts, allowed`` of a stream of requests: ``limit`` of an identity are let through in each window.

    A window opens at the first request outside the last one. Rows of a batch are taken in order of time and id; of batches the
    earlier counts as earlier. An identity of which nothing came for ``idle`` seconds of processing time is forgotten; a
    window is never forgotten before it closes.
    """
    kept = int(1000 * max(idle, seconds))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, used = state.get if state.exists else (None, 0)
        batch = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        flags = []
        for t in batch["ts"].astype("datetime64[us]").astype("int64") / 1e6:
            if opened is None or t - opened >= seconds:
                opened, used = t, 0
            used += 1
            flags.append(used <= limit)
        state.update((float(opened), used))
        state.setTimeoutDuration(kept)
        yield batch[["user_id", "event_id", "ts"]].assign(allowed=flags)

    grouped = requests.select("user_id", "event_id", "ts").groupBy("user_id")
    return grouped.applyInPandasWithState(run, ALLOWED, "opened double, used long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def watched_jobs(statuses: DataFrame, patience: float, retries: int) -> DataFrame:
    """``job_key, action, attempts``: of a stream ``job_key, status, at`` what is to be done with jobs that are stuck.

    A job that stays ``queued`` or ``retrying`` for ``patience`` seconds is queued again, ``retries`` times; then it has failed.
    Any other status ends the wait and forgets the job.
    """
    wait = max(1, int(1000 * patience))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            attempts = state.get[0] + 1
            if attempts <= retries:
                state.update((attempts,))
                state.setTimeoutDuration(wait)
            else:
                state.remove()
            yield pd.DataFrame({"job_key": [key[0]], "action": ["requeue" if attempts <= retries else "fail"], "attempts": [attempts]})
            return
        told = pd.concat(list(frames)).sort_values("at", kind="stable")
        if told["status"].iloc[-1] in ("queued", "retrying"):
            state.update(state.get if state.exists else (0,))
            state.setTimeoutDuration(wait)
        elif state.exists:
            state.remove()

    grouped = statuses.select("job_key", "status", "at").groupBy("job_key")
    return grouped.applyInPandasWithState(run, ACTIONS, "attempts long", "append", GroupStateTimeout.ProcessingTimeTimeout)
