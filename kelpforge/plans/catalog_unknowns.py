"""Queries over unknown items, pending counts, deletions and uploads; events are the items, parts and orders the uploads and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from ..operators import unknowns as U
from .catalog_records import FACTS, _facts, _pick
from .catalog_versions import ROLES, _role
from .registry import query

KINDS = ["service_price", "discount_rule", "weather", "faq_item"]
TARGETS = ["extracted_facts", "business_rules", "nowhere"]
STATES = ["open", "mapped", "ignored", "schema_requested"]
ITEMS = f"items AS (SELECT event_id AS item_id, 'w' || (user_id % 3) AS workspace_id, ({STATES})[(event_id % 4 + 1)::INT] AS status, ts AS created_at FROM events WHERE event_id % 11 <> 0)"


def _items(t):
    key = F.col("event_id")
    return t("events").where(key % 11 != 0).select(key.alias("item_id"), F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string")).alias("workspace_id"), _pick(STATES, key % 4).alias("status"), F.col("ts").alias("created_at"))


@query(f"""
WITH {ITEMS}, r AS (SELECT event_id AS item_id, 'w' || (user_id % 3 + (event_id % 13 = 0)::INT) AS workspace_id, ({KINDS})[(event_id // 4 % 4 + 1)::INT] AS fact_type, ({TARGETS})[(event_id // 3 % 3 + 1)::INT] AS destination, ({ROLES})[(event_id // 5 % 3 + 1)::INT] AS role FROM events),
j AS (SELECT r.*, i.status, CASE WHEN fact_type = 'weather' THEN 'invalid_fact_type' WHEN destination = 'nowhere' THEN 'invalid_destination' WHEN (fact_type = 'discount_rule') <> (destination = 'business_rules') THEN 'invalid_destination_for_fact_type'
  WHEN i.workspace_id IS NULL OR i.workspace_id <> r.workspace_id THEN 'unknown_item_not_found' WHEN role = 'viewer' THEN 'permission_denied' WHEN i.status = 'mapped' THEN 'already_mapped' WHEN i.status = 'ignored' THEN 'already_ignored' END AS reason FROM r LEFT JOIN items i USING (item_id))
SELECT item_id, fact_type, destination, reason, CASE WHEN reason IS NULL THEN 'mapped' ELSE status END AS new_status, CASE WHEN reason IS NULL THEN sha256('extraction:manual:' || item_id || ':' || fact_type || ':' || destination) END AS job_key,
  CASE WHEN reason IS NULL THEN 'queued' END AS job_status FROM j""")
def unknown_reclassified(t):
    key = F.col("event_id")
    asked = t("events").select(
        key.alias("item_id"), F.concat(F.lit("w"), (F.col("user_id") % 3 + (key % 13 == 0).cast("int")).cast("string")).alias("workspace_id"), _pick(KINDS, F.floor(key / 4) % 4).alias("fact_type"), _pick(TARGETS, F.floor(key / 3) % 3).alias("destination"), _role(F.floor(key / 5)),
    )
    return U.reclassified(_items(t), asked)


@query(f"""
WITH {ITEMS}, r AS (SELECT event_id AS item_id, ({ROLES})[(event_id // 5 % 3 + 1)::INT] AS role FROM events),
j AS (SELECT r.item_id, status, CASE WHEN status IS NULL THEN 'unknown_item_not_found' WHEN role = 'viewer' THEN 'permission_denied' WHEN status = 'mapped' THEN 'already_mapped' END AS reason FROM r LEFT JOIN items i ON i.item_id = r.item_id)
SELECT item_id, reason, CASE WHEN reason IS NULL THEN 'ignored' ELSE status END AS new_status, reason IS NULL AND status <> 'ignored' AS is_event FROM j""")
def unknown_ignored(t):
    return U.ignored(_items(t), t("events").select(F.col("event_id").alias("item_id"), _role(F.floor(F.col("event_id") / 5))))


@query(f"WITH {ITEMS} SELECT item_id, status, count(*) OVER () AS total FROM items WHERE workspace_id = 'w1' AND status = 'open' ORDER BY created_at DESC, item_id LIMIT 20 OFFSET 20")
def unknown_queue(t):
    mine = R.tenant(_items(t), "w1").where("status = 'open'")
    page = R.page_of(mine, [F.desc("created_at"), F.asc("item_id")], 2, 20)
    return page.select("item_id", "status", mine.agg(F.count("*")).scalar().alias("total"))


@query(f"""
WITH {FACTS}, items AS (SELECT event_id % 2000 AS source_id, ({STATES})[(event_id % 4 + 1)::INT] AS status, event_id % 5 = 0 AS resolved FROM events), c AS (SELECT o_custkey AS cid, o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'open' ELSE 'resolved' END AS status FROM orders),
x AS (SELECT o_orderkey AS source_id, 0 AS records, 0 AS unpublished, 1 AS review FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT source_id, 0, 0, 1 FROM items WHERE status IN ('open', 'schema_requested') AND NOT resolved
  UNION ALL SELECT source_id, 1, (status NOT IN ('published', 'rejected'))::INT, (status IN ('needs_review', 'conflicted'))::INT FROM facts),
y AS (SELECT source_id, count(DISTINCT cid) AS review FROM c JOIN facts ON record_id = k * 10 + 1 OR record_id = k * 10 + 2 WHERE c.status = 'open' GROUP BY 1),
z AS (SELECT source_id, sum(records) AS records, sum(unpublished) AS unpublished, sum(review) AS review FROM (SELECT * FROM x UNION ALL SELECT source_id, 0, 0, review FROM y) GROUP BY 1)
SELECT source_id, records::BIGINT AS source_records, unpublished::BIGINT AS unpublished, review::BIGINT AS review_pending, CASE WHEN review > 0 THEN 'needs_review' WHEN records > 0 AND unpublished = 0 THEN 'published' ELSE 'extracted' END AS status FROM z""")
def source_pending(t):
    key, orders = F.col("o_orderkey"), t("orders")
    chunks = orders.select(key.alias("source_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "needs_review").otherwise("classified").alias("status"))
    items = t("events").select((F.col("event_id") % 2000).alias("source_id"), _pick(STATES, F.col("event_id") % 4).alias("status"), F.when(F.col("event_id") % 5 == 0, F.col("ts")).alias("resolved_at"))
    listed = orders.select(F.col("o_custkey").alias("contradiction_id"), F.array(key * 10 + 1, key * 10 + 2).alias("record_ids"), F.when(F.col("o_orderstatus") == "F", "open").otherwise("resolved").alias("status"))
    return U.pending_counts(chunks, items, _facts(t), listed).withColumn("status", U.settled_status())


def _asked_deletions(t):
    key = F.col("n_nationkey")
    return t("nation").where(key % 3 == 0).select(key.alias("workspace_id"), F.concat(F.lit("r"), key.cast("string")).alias("request_id"))


def _stored(t):
    key = F.col("c_custkey")
    return t("customer").select(key.alias("source_id"), F.col("c_nationkey").alias("workspace_id"), F.when(key % 4 == 0, F.lit("1995-01-01").cast("timestamp")).alias("deleted_at"), F.when(key % 5 == 0, "").when(key % 5 != 1, F.concat(F.lit("p/"), key.cast("string"))).alias("storage_path"))


@query("""
SELECT c_custkey AS source_id, c_nationkey AS workspace_id, 'r' || c_nationkey AS request_id, c_custkey % 5 > 1 AS pending_storage_delete, c_custkey % 5 > 1 AND c_custkey % 2 = 0 AS removable FROM customer WHERE c_nationkey % 3 = 0 AND c_custkey % 4 <> 0""")
def privacy_deletions(t):
    at = F.when(F.col("source_id") % 2 == 0, F.lit("1996-01-01").cast("timestamp")).otherwise(F.lit("1997-01-01").cast("timestamp"))
    gone = U.deleted_sources(_stored(t), _asked_deletions(t), at)
    free = U.removable_objects(gone, F.lit("1996-06-30").cast("timestamp")).select("source_id", F.lit(True).alias("removable"))
    return gone.join(free, "source_id", "left").select("source_id", "workspace_id", "request_id", "pending_storage_delete", F.coalesce("removable", F.lit(False)).alias("removable"))


@query("""
SELECT e.event_id AS audit_id, c_nationkey AS workspace_id, CASE WHEN c_nationkey % 3 <> 0 THEN user_id END AS user_id, CASE WHEN c_nationkey % 3 = 0 THEN '[privacy_deleted]' ELSE event_type END AS question,
  CASE WHEN c_nationkey % 3 = 0 THEN '[privacy_deleted]' ELSE 'a' || event_id END AS answer, CASE WHEN c_nationkey % 3 = 0 THEN 'privacy_deleted:r' || c_nationkey ELSE 'v1' END AS prompt_version
FROM (SELECT *, (event_id % 25)::INT AS c_nationkey FROM events) e""")
def audits_anonymised(t):
    key = F.col("event_id")
    audits = t("events").select(key.alias("audit_id"), (key % 25).cast("int").alias("workspace_id"), "user_id", F.col("event_type").alias("question"), F.concat(F.lit("a"), key.cast("string")).alias("answer"), F.lit("v1").alias("prompt_version"))
    return U.anonymised(audits, _asked_deletions(t))


@query("""
WITH u AS (SELECT o_orderkey AS upload_id, o_custkey % 7 AS workspace_id, CASE WHEN o_orderkey % 10 <> 0 THEN 'h' || (o_custkey % 200) END AS file_hash, o_orderdate AS created_at FROM orders),
s AS (SELECT DISTINCT c_custkey % 7 AS workspace_id, 'h' || (c_custkey % 200) AS file_hash FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 200 < 50)
SELECT upload_id, file_hash IS NULL OR (row_number() OVER (PARTITION BY workspace_id, file_hash ORDER BY created_at, upload_id) = 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.workspace_id = u.workspace_id AND s.file_hash = u.file_hash)) AS accepted FROM u""")
def upload_dedup(t):
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    hashed = lambda c: F.concat(F.lit("h"), (c % 200).cast("string"))
    uploads = t("orders").select(key.alias("upload_id"), (who % 7).alias("workspace_id"), F.when(key % 10 != 0, hashed(who)).alias("file_hash"), F.col("o_orderdate").alias("created_at"))
    own = F.col("c_custkey")
    live = t("customer").where(own % 200 < 50).select((own % 7).alias("workspace_id"), hashed(own).alias("file_hash"), F.when(own % 4 == 0, F.lit("1995-01-01").cast("timestamp")).alias("deleted_at"))
    return U.accepted_uploads(uploads, live)


JOBS = ["succeeded", "failed", "running", "", "odd"]


@query(f"""
WITH s AS (SELECT c_custkey AS workspace_id, c_custkey % 9 <> 0 AS up, ({JOBS})[(c_custkey % 5 + 1)::INT] AS job, c_custkey % 2 AS sources, c_custkey % 3 AS review, (c_custkey // 2) % 4 AS known FROM customer)
SELECT workspace_id, CASE WHEN up THEN 'ready' ELSE 'blocked' END AS runtime, CASE WHEN NOT up THEN 'blocked' WHEN sources > 0 THEN 'ready' ELSE 'next' END AS upload,
  CASE WHEN NOT up THEN 'blocked' WHEN job = '' THEN 'next' WHEN job = 'succeeded' THEN 'ready' ELSE 'attention' END AS pipeline, CASE WHEN NOT up THEN 'blocked' WHEN review > 0 THEN 'attention' ELSE 'ready' END AS review,
  CASE WHEN NOT up THEN 'blocked' WHEN known > 0 THEN 'ready' ELSE 'next' END AS query, CASE WHEN NOT up THEN 'error' WHEN known > 0 THEN 'success' ELSE 'warning' END AS tone FROM s""")
def pilot_steps(t):
    key = F.col("c_custkey")
    seen = t("customer").select(
        key.alias("workspace_id"), (key % 9 != 0).alias("api_reachable"), _pick(JOBS, key % 5).alias("latest_job_status"), (key % 2).alias("source_count"), (key % 3).alias("review_pending"), F.lit(0).alias("unknown_open"), (F.floor(key / 2) % 4).alias("knowledge_total"),
    )
    return U.pilot_steps(seen)
