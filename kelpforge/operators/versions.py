"""Versions, replacements, rollbacks and claims as append-only decisions: a row for each request, accepted or with its reason.

Records are facts and rules alike, ``record_id, record_class, source_id, workspace_id, status, superseded_by``; a request
that names an unknown record is refused, never dropped. Repeated requests are judged each against the state before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
REVIEWERS = ["owner", "manager", "reviewer"]
MANAGERS = ["owner", "manager"]
NOT_EDITED = ["published", "deprecated"]
ROLLED_BACK = ["approved", "published", "conflicted"]
CLAIMABLE = ["queued", "retrying"]


def _reason(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that fails."""
    out = F.when(checks[0][0], checks[0][1])
    for failed, name in checks[1:]:
        out = out.when(failed, name)
    return out


def new_versions(records: DataFrame, edits: DataFrame) -> DataFrame:
    """``record_id, new_id, content, role`` in. An accepted edit makes an approved version ``new_id`` and supersedes the old one."""
    joined = edits.join(records, "record_id", "left")
    why = _reason(
        (F.col("status").isNull(), "not_found"), (~F.col("role").isin(REVIEWERS), "permission_denied"), (F.col("superseded_by").isNotNull(), "already_superseded"), (F.col("status").isin(NOT_EDITED), "invalid_status")
    )
    judged = joined.withColumn("reason", why)
    ok = F.col("reason").isNull()
    return judged.select(
        "record_id", "record_class", "reason", F.when(ok, F.col("new_id")).alias("new_id"), F.when(ok, F.col("content")).alias("content"), F.when(ok, "approved").alias("new_version_status"),
        F.col("status").alias("previous_status"), F.when(ok, "superseded").otherwise(F.col("status")).alias("new_status"),
    )


def replacements(records: DataFrame, requests: DataFrame) -> DataFrame:
    """``record_id, replacement_id, role`` in. An accepted request supersedes a record by another one of the same workspace and class."""
    other = records.select(F.col("record_id").alias("replacement_id"), F.col("workspace_id").alias("_workspace"), F.col("record_class").alias("_class"))
    joined = requests.join(records, "record_id", "left").join(other, "replacement_id", "left")
    why = _reason(
        (F.col("status").isNull(), "old_not_found"), (F.col("_workspace").isNull() | (F.col("_class") != F.col("record_class")), "replacement_not_found"), (F.col("_workspace") != F.col("workspace_id"), "workspace_mismatch"),
        (~F.col("role").isin(REVIEWERS), "permission_denied"),
    )
    judged = joined.withColumn("reason", why)
    ok = F.col("reason").isNull()
    return judged.select("record_id", "replacement_id", "reason", F.col("status").alias("previous_status"), F.when(ok, "superseded").otherwise(F.col("status")).alias("new_status"), F.when(ok, F.col("replacement_id")).alias("superseded_by"))


def rollbacks(records: DataFrame, sources: DataFrame, requests: DataFrame) -> DataFrame:
    """``source_id, role`` in. An accepted request deprecates the source and its approved, published and conflicted records.

    Only records of the sources asked for are counted, with map-side sums.
    """
    affected = records.where(F.col("status").isin(ROLLED_BACK)).join(requests.select("source_id").distinct(), "source_id", "left_semi")
    counts = affected.groupBy("source_id").agg(F.count_if(F.col("record_class") == "fact").alias("facts"), F.count_if(F.col("record_class") == "rule").alias("rules"))
    joined = requests.join(sources.select("source_id", "source_status"), "source_id", "left").join(counts, "source_id", "left")
    judged = joined.withColumn("reason", _reason((F.col("source_status").isNull(), "source_not_found"), (~F.col("role").isin(MANAGERS), "permission_denied")))
    ok = F.col("reason").isNull()
    number = lambda c: F.when(ok, F.coalesce(c, F.lit(0))).otherwise(F.lit(0).cast("long")).alias(f"deprecated_{c}")
    return judged.select("source_id", "role", "reason", F.col("source_status").alias("previous_status"), F.when(ok, "deprecated").otherwise(F.col("source_status")).alias("new_status"), number("facts"), number("rules"))


def claims(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """``job_id, worker_id, at`` in: the jobs that are taken. Of several workers that ask for a waiting job the first gets it."""
    first = asked.groupBy("job_id").agg(F.min(F.struct("at", "worker_id")).alias("first"))
    return jobs.where(F.col("status").isin(CLAIMABLE)).join(first, "job_id").select("job_id", F.lit("running").alias("status"), F.col("first.worker_id").alias("worker_id"), F.col("first.at").alias("started_at"))
