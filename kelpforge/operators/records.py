"""Records and their states: published views, review queues, transitions as events, jobs, revision families.

Tables are append-only: a transition is a row, and a state is a fold over rows by a key with map-side partial results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Fixed values.
PENDING = ["extracted", "needs_review"]
BLOCKING = ["open", "needs_review"]
ACTIVE = ["approved", "vigent"]
#: Action: the statuses it starts from, the status it ends in, the roles that may take it.
ACTIONS = {
    "approve": (["extracted", "needs_review", "approved"], "approved", ["owner", "manager", "reviewer"]),
    "publish": (["approved"], "published", ["owner", "manager"]),
    "reject": (["extracted", "needs_review", "approved", "rejected", "conflicted"], "rejected", ["owner", "manager", "reviewer"]),
    "supersede": (["extracted", "needs_review", "approved", "published", "rejected", "conflicted"], "superseded", ["owner", "manager", "reviewer"]),
    "deprecate": (["approved", "published", "conflicted"], "deprecated", ["owner", "manager"]),
    "contradict": (["approved", "published"], "conflicted", ["owner", "manager", "reviewer"]),
}


def tenant(table: DataFrame, workspace: str) -> DataFrame:
    """The rows of one workspace: the predicate that every scan of a tenant's table begins with."""
    return table.where(F.col("workspace_id") == workspace)


def published(records: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """Published, not superseded and valid records of published, not deleted sources."""
    valid = (F.col("valid_from").isNull() | (F.col("valid_from") <= as_of)) & (F.col("valid_until").isNull() | (F.col("valid_until") > as_of))
    live = records.where((F.col("status") == "published") & F.col("superseded_by").isNull() & valid)
    shown = sources.where((F.col("source_status") == "published") & F.col("deleted_at").isNull()).select("source_id", "workspace_id")
    return live.join(shown, ["source_id", "workspace_id"])


def contradicted(records: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Records named by a contradiction that still blocks: an equality join on the exploded members."""
    members = contradictions.where(F.col("status").isin(BLOCKING)).select(F.explode("record_ids").alias("record_id")).distinct()
    return records.join(members, "record_id", "left_semi")


def review_queue(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Counts of facts and of pending ones for each chunk that has a pending fact; first pending time orders the queue."""
    counts = facts.groupBy("chunk_id").agg(F.count("*").alias("facts"), F.count_if(F.col("status").isin(PENDING)).alias("pending"), F.min(F.when(F.col("status").isin(PENDING), F.col("created_at"))).alias("first_pending"))
    return chunks.join(counts.where("pending > 0"), "chunk_id")


def page_of(rows: DataFrame, order: list[Column], page: int, per_page: int) -> DataFrame:
    """One page of rows in a total order; a top-k of what lies up to its end."""
    return rows.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def source_state(children: DataFrame) -> DataFrame:
    """The status of each source from its children ``source_id, kind, status``: failed, processing, in review, extracted or published."""
    jobs, records = F.col("kind") == "job", F.col("kind") == "record"
    summed = children.groupBy("source_id").agg(
        F.count_if(jobs & F.col("status").isin("queued", "running", "retrying")).alias("active"),
        F.count_if(jobs & (F.col("status") == "failed")).alias("failed"),
        F.count_if(records & F.col("status").isin(PENDING)).alias("pending"),
        F.count_if(records & ~F.col("status").isin("published", "rejected", "superseded", "deprecated")).alias("unpublished"),
        F.count_if(records & (F.col("status") == "published")).alias("published"),
    )
    state = F.when(F.col("active") > 0, "processing").when(F.col("failed") > 0, "failed").when(F.col("pending") > 0, "needs_review")
    state = state.when((F.col("unpublished") == 0) & (F.col("published") > 0), "published").otherwise("extracted")
    return summed.withColumn("source_status", state)


def latest(events: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's last event: one partial aggregate, no window."""
    top = F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("top")
    return events.groupBy(*keys).agg(top).select(*keys, *[F.col(f"top.{c}").alias(c) for c in columns])


def transitions(states: DataFrame, requests: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """An accepted or rejected event for each request ``record_id, action, role`` against the current ``record_id, status``."""
    joined = requests.join(states, "record_id", "left")
    if blocked is not None:
        joined = joined.join(blocked.select("record_id", F.lit(True).alias("blocked")), "record_id", "left")
    else:
        joined = joined.withColumn("blocked", F.lit(None).cast("boolean"))
    reason, target = F.lit("unknown_action"), F.lit(None).cast("string")
    for action, (starts, end, roles) in ACTIONS.items():
        why = F.when(F.col("status").isNull(), "not_found").when(~F.col("role").isin(roles), "forbidden").when(~F.col("status").isin(starts), "invalid_status")
        if action == "publish":
            why = why.when(F.col("blocked"), "open_contradiction")
        reason = F.when(F.col("action") == action, why).otherwise(reason)
        target = F.when(F.col("action") == action, end).otherwise(target)
    judged = joined.withColumn("reason", reason)
    return judged.select("record_id", "action", "role", "status", F.col("reason").isNull().alias("accepted"), "reason", F.when(F.col("reason").isNull(), target).alias("new_status"))


def first_jobs(jobs: DataFrame) -> DataFrame:
    """The earliest job of each idempotency key."""
    return jobs.groupBy("idempotency_key").agg(F.min(F.struct("created_at", "job_id")).alias("first"), F.count("*").alias("requests")).select("idempotency_key", "first.job_id", "first.created_at", "requests")


def stale_jobs(jobs: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """Queued jobs that no worker has taken for so many minutes."""
    return jobs.where((F.col("status") == "queued") & (F.col("created_at") < as_of - F.expr(f"INTERVAL {minutes} MINUTES")))


def orphans(objects: DataFrame, references: DataFrame) -> DataFrame:
    """Stored objects that nothing refers to."""
    return objects.join(references.select("object_id").distinct(), "object_id", "left_anti")


def revision_families(documents: DataFrame) -> DataFrame:
    """For each ``document_code`` its revisions in order, the candidate, the gaps, and the one in force if there is none.

    Numbers come first, by value; then other revisions by text.
    """
    key = F.when(F.col("revision").rlike(r"^\d+$"), F.struct(F.lit(0).alias("kind"), F.col("revision").cast("long").alias("number"), F.col("revision").alias("name"))).otherwise(
        F.struct(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("number"), F.col("revision").alias("name"))
    )
    has = F.col("revision") != ""
    active = has & F.col("status").isin(ACTIVE)
    # contents are counted by revision first, so that a revision's copies do not meet in one set
    by_revision = documents.withColumn("key", F.when(has, key)).groupBy("document_code", "revision").agg(
        F.first("key").alias("key"), F.max(active).alias("active"), F.max(has & (F.col("status") == "obsolete")).alias("obsolete"), F.count_distinct(F.when(F.col("content_hash") != "", F.col("content_hash"))).alias("contents"), F.max(~has).alias("unnamed")
    )
    summed = by_revision.groupBy("document_code").agg(
        F.array_sort(F.collect_list("key")).alias("keys"),
        F.max(F.when(F.col("active"), F.col("key"))).alias("highest_active"),
        F.max("unnamed").alias("unnamed"),
        F.max((F.col("contents") > 1) & ~F.col("unnamed")).alias("conflict"),
        F.collect_list(F.when(F.col("active"), F.col("revision"))).alias("actives"),
        F.collect_list(F.when(F.col("obsolete"), F.col("revision"))).alias("obsoletes"),
    )
    candidate = F.coalesce(F.col("highest_active.name"), F.get(F.col("keys.name"), F.size("keys") - 1))
    named = summed.withColumn("candidate_revision", candidate)
    older = F.array_except(F.array_except("actives", F.array("candidate_revision")), F.col("obsoletes"))
    gaps = F.array_compact(F.array(F.when(F.col("unnamed"), "missing_revision"), F.when(F.col("conflict"), "duplicate_revision_conflict"), F.when((F.size("actives") > 1) & (F.size(older) > 0), "ambiguous_vigent_revision")))
    return named.withColumn("gaps", gaps).select(
        "document_code", F.array_join("keys.name", ",").alias("revision_order"), "candidate_revision", F.array_join("gaps", ",").alias("blocking_gaps"), F.when(F.size("gaps") == 0, F.col("candidate_revision")).alias("vigent_revision")
    )


def normalized_documents(documents: DataFrame) -> DataFrame:
    """Codes, revisions and statuses in their normal forms; odd statuses are unknown."""
    status = X.document_status(F.col("status"))
    return documents.withColumns({"document_code": X.document_code(F.col("document_code")), "revision": X.revision(F.coalesce("revision", F.lit(""))), "status": F.when(status.isin("draft", "approved", "vigent", "obsolete"), status).otherwise("unknown")})


def broken_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges ``from_id, to_id`` of which an end is no known node."""
    known = nodes.select("node_id").distinct()
    ends = [known.select(F.col("node_id").alias(end), F.lit(True).alias(f"has_{end}")) for end in ("from_id", "to_id")]
    both = edges.join(ends[0], "from_id", "left").join(ends[1], "to_id", "left")
    return both.where("has_from_id IS NULL OR has_to_id IS NULL").select(*edges.columns)


def numbered(rows: DataFrame, group: str, order: str, first: int = 1) -> DataFrame:
    """A running number within each group."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(order)) + (first - 1))
