"""Unknown items, deletions and the state of a workspace, as append-only decisions and views over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import idempotency_key
from .records import BLOCKING
from .versions import REVIEWERS

# Fixed values.
FACT_TYPES = ["service_price", "business_hours", "payment_method", "contact_info", "faq_item"]
RULE_TYPES = ["discount_rule", "cancellation_policy"]
DONE_JOBS = ["completed", "succeeded", "success"]
DESTINATIONS = {"fact": "extracted_facts", "rule": "business_rules"}
OPEN_ITEMS = ["open", "schema_requested"]
IN_REVIEW = ["needs_review", "conflicted"]
SETTLED = ["published", "rejected"]
MASK = "[privacy_deleted]"


def reclassified(items: DataFrame, requests: DataFrame) -> DataFrame:
    """A decision for each request ``item_id, workspace_id, fact_type, destination, role`` against items ``item_id, workspace_id, status``.

    The first reason that holds refuses it: unknown type, unknown or wrong destination, item not in the workspace, role, item
    mapped or ignored. An accepted one maps the item and queues an extraction job under a key of item, type and destination, so
    that a repeated request names the same job. Each request is judged against the state before all of them.
    """
    held = items.select("item_id", F.col("workspace_id").alias("_own"), F.col("status").alias("previous_status"))
    kind, to = F.col("fact_type"), F.col("destination")
    wanted = F.when(kind.isin(FACT_TYPES), DESTINATIONS["fact"]).when(kind.isin(RULE_TYPES), DESTINATIONS["rule"])
    why = (
        F.when(kind.isNull() | ~kind.isin(FACT_TYPES + RULE_TYPES), "invalid_fact_type")
        .when(to.isNull() | ~to.isin(list(DESTINATIONS.values())), "invalid_destination")
        .when(to != wanted, "invalid_destination_for_fact_type")
        .when(F.col("_own").isNull() | (F.col("_own") != F.col("workspace_id")), "unknown_item_not_found")
        .when(F.col("role").isNull() | ~F.col("role").isin(REVIEWERS), "permission_denied")
        .when(F.col("previous_status") == "mapped", "already_mapped")
        .when(F.col("previous_status") == "ignored", "already_ignored")
    )
    judged = requests.join(held, "item_id", "left").withColumn("reason", why)
    ok = F.col("reason").isNull()
    key = idempotency_key(F.lit("extraction"), F.lit("manual"), F.col("item_id").cast("string"), kind, to)
    return judged.select("item_id", "fact_type", "destination", "reason", F.when(ok, "mapped").otherwise(F.col("previous_status")).alias("new_status"), F.when(ok, key).alias("job_key"), F.when(ok, "queued").alias("job_status"))


def ignored(items: DataFrame, requests: DataFrame) -> DataFrame:
    """A decision for each request ``item_id, role`` to ignore an item; ignoring an ignored one changes nothing and is no event."""
    judged = requests.join(items.select("item_id", F.col("status").alias("previous_status")), "item_id", "left").withColumn(
        "reason",
        F.when(F.col("previous_status").isNull(), "unknown_item_not_found").when(F.col("role").isNull() | ~F.col("role").isin(REVIEWERS), "permission_denied").when(F.col("previous_status") == "mapped", "already_mapped"),
    )
    ok = F.col("reason").isNull()
    return judged.select("item_id", "reason", F.when(ok, "ignored").otherwise(F.col("previous_status")).alias("new_status"), (ok & (F.col("previous_status") != "ignored")).alias("is_event"))


def pending_counts(chunks: DataFrame, items: DataFrame, records: DataFrame, contradictions: DataFrame) -> DataFrame:
    """``source_id, source_records, unpublished, review_pending`` of each source that has any of them.

    Chunks, items and records have ``source_id, status``; an item counts until it is resolved. A contradiction
    ``contradiction_id, record_ids, status`` counts once for each source that has one of its records. Every part is summed
    by source before they meet.
    """
    member = contradictions.where(F.col("status").isin(BLOCKING)).select("contradiction_id", F.explode("record_ids").alias("record_id"))
    touched = member.join(records.select("record_id", "source_id"), "record_id").groupBy("source_id").agg(F.count_distinct("contradiction_id").alias("review"))
    zero = F.lit(0).cast("long")
    parts = [
        chunks.where("status = 'needs_review'").groupBy("source_id").agg(F.count("*").alias("review")).select("source_id", zero.alias("records"), zero.alias("unpublished"), "review"),
        items.where(F.col("status").isin(OPEN_ITEMS) & F.col("resolved_at").isNull()).groupBy("source_id").agg(F.count("*").alias("review")).select("source_id", zero.alias("records"), zero.alias("unpublished"), "review"),
        records.groupBy("source_id").agg(F.count("*").alias("records"), F.count_if(~F.col("status").isin(SETTLED)).alias("unpublished"), F.count_if(F.col("status").isin(IN_REVIEW)).alias("review")),
        touched.select("source_id", zero.alias("records"), zero.alias("unpublished"), "review"),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("source_id").agg(F.sum("records").alias("source_records"), F.sum("unpublished").alias("unpublished"), F.sum("review").alias("review_pending"))


def settled_status() -> Column:
    """The status of a source without running or failed jobs, from its pending counts."""
    return F.when(F.col("review_pending") > 0, "needs_review").when((F.col("source_records") > 0) & (F.col("unpublished") == 0), "published").otherwise("extracted")


def deleted_sources(sources: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """The live sources of the workspaces in ``workspace_id, request_id``, marked deleted; stored ones wait for their object's removal."""
    live = sources.where("deleted_at IS NULL").join(requests, "workspace_id")
    return live.select("source_id", "workspace_id", "request_id", at.alias("deleted_at"), F.coalesce((F.col("storage_path") != ""), F.lit(False)).alias("pending_storage_delete"))


def anonymised(audits: DataFrame, requests: DataFrame) -> DataFrame:
    """Question logs with the rows of deleted workspaces masked; all others unchanged. One request for each workspace."""
    joined = audits.join(requests, "workspace_id", "left")
    gone = F.col("request_id").isNotNull()
    return joined.withColumns({
        "user_id": F.when(~gone, F.col("user_id")), "question": F.when(gone, MASK).otherwise(F.col("question")), "answer": F.when(gone, MASK).otherwise(F.col("answer")),
        "prompt_version": F.when(gone, F.concat(F.lit("privacy_deleted:"), F.col("request_id").cast("string"))).otherwise(F.col("prompt_version")),
    }).drop("request_id")


def removable_objects(deleted: DataFrame, before: Column) -> DataFrame:
    """Stored objects of sources that were deleted before a time."""
    return deleted.where(F.col("pending_storage_delete") & (F.col("deleted_at") < before)).select("source_id", "workspace_id")


def accepted_uploads(uploads: DataFrame, sources: DataFrame) -> DataFrame:
    """``upload_id, accepted``: the first upload of a file's hash in a workspace that has no live source with it; nulls are no equals.

    First is the least ``created_at, upload_id``, a fold with map-side partial results.
    """
    keys = ["workspace_id", "file_hash"]
    held = sources.where("deleted_at IS NULL").select(*keys).distinct().withColumn("_held", F.lit(True))
    first = uploads.groupBy(*keys).agg(F.min(F.struct("created_at", "upload_id")).alias("_first")).select(*keys, F.col("_first.upload_id").alias("_upload"))
    joined = uploads.join(first, keys, "left").join(held, keys, "left")
    alone = F.col("file_hash").isNull() | F.col("workspace_id").isNull()
    return joined.select("upload_id", (alone | (F.col("_held").isNull() & (F.col("upload_id") == F.col("_upload")))).alias("accepted"))


def pilot_steps(snapshots: DataFrame) -> DataFrame:
    """``workspace_id, runtime, upload, pipeline, review, query, tone`` from a snapshot of each workspace's counts."""
    up = F.coalesce("api_reachable", F.lit(False))
    job = F.col("latest_job_status")
    pipeline = F.when(job.isNull() | (job == ""), "next").when(job.isin(DONE_JOBS), "ready").otherwise("attention")
    guarded = lambda name, c: F.when(~up, "blocked").otherwise(c).alias(name)
    return snapshots.select(
        "workspace_id", guarded("runtime", F.lit("ready")), guarded("upload", F.when(F.col("source_count") > 0, "ready").otherwise("next")), guarded("pipeline", pipeline),
        guarded("review", F.when((F.col("review_pending") > 0) | (F.col("unknown_open") > 0), "attention").otherwise("ready")), guarded("query", F.when(F.col("knowledge_total") > 0, "ready").otherwise("next")),
        F.when(~up, "error").when(F.col("knowledge_total") > 0, "success").otherwise("warning").alias("tone"),
    )
