"""Queries over versions, replacements, rollbacks and claims; line items are the records, orders their sources, events the jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import versions as V
from .catalog_records import FACTS, _facts
from .registry import query

ROLES = ["owner", "reviewer", "viewer"]
RECORDS = f"{FACTS}, recs AS (SELECT *, CASE WHEN record_id % 3 = 0 THEN 'rule' ELSE 'fact' END AS record_class FROM facts)"


def _records(t):
    return _facts(t).withColumn("record_class", F.when(F.col("record_id") % 3 == 0, "rule").otherwise("fact"))


def _role(key):
    return F.element_at(F.array(*[F.lit(x) for x in ROLES]), (F.pmod(key, F.lit(3)) + 1).cast("int")).alias("role")


@query(f"""
WITH {RECORDS}, e AS (SELECT o_orderkey * 10 + 1 AS record_id, -o_orderkey AS new_id, 'c' || o_orderkey AS content, ({ROLES})[(o_custkey % 3 + 1)::INT] AS role FROM orders UNION ALL SELECT -1, -1, 'x', 'owner'),
j AS (SELECT e.*, record_class, status, CASE WHEN status IS NULL THEN 'not_found' WHEN role = 'viewer' THEN 'permission_denied' WHEN superseded_by IS NOT NULL THEN 'already_superseded' WHEN status IN ('published', 'deprecated') THEN 'invalid_status' END AS reason FROM e LEFT JOIN recs USING (record_id))
SELECT record_id, record_class, reason, CASE WHEN reason IS NULL THEN new_id END AS new_id, CASE WHEN reason IS NULL THEN content END AS content, CASE WHEN reason IS NULL THEN 'approved' END AS new_version_status,
  status AS previous_status, CASE WHEN reason IS NULL THEN 'superseded' ELSE status END AS new_status FROM j""")
def record_versions(t):
    key = F.col("o_orderkey")
    edits = t("orders").select((key * 10 + 1).alias("record_id"), (-key).alias("new_id"), F.concat(F.lit("c"), key.cast("string")).alias("content"), _role(F.col("o_custkey")))
    return V.new_versions(_records(t), edits.union(edits.sparkSession.createDataFrame([(-1, -1, "x", "owner")], edits.schema)))


@query(f"""
WITH {RECORDS}, q AS (SELECT o_orderkey * 10 + 1 AS record_id, o_orderkey * 10 + 1 + o_custkey % 5 AS replacement_id, ({ROLES})[(o_orderkey % 3 + 1)::INT] AS role FROM orders),
j AS (SELECT q.*, a.status, CASE WHEN a.status IS NULL THEN 'old_not_found' WHEN b.workspace_id IS NULL OR b.record_class <> a.record_class THEN 'replacement_not_found' WHEN b.workspace_id <> a.workspace_id THEN 'workspace_mismatch' WHEN role = 'viewer' THEN 'permission_denied' END AS reason
  FROM q LEFT JOIN recs a USING (record_id) LEFT JOIN recs b ON b.record_id = q.replacement_id)
SELECT record_id, replacement_id, reason, status AS previous_status, CASE WHEN reason IS NULL THEN 'superseded' ELSE status END AS new_status, CASE WHEN reason IS NULL THEN replacement_id END AS superseded_by FROM j""")
def record_replacements(t):
    key = F.col("o_orderkey")
    return V.replacements(_records(t), t("orders").select((key * 10 + 1).alias("record_id"), (key * 10 + 1 + F.col("o_custkey") % 5).alias("replacement_id"), _role(key)))


@query(f"""
WITH {RECORDS}, q AS (SELECT c_custkey * 3 AS source_id, ({ROLES})[(c_custkey % 3 + 1)::INT] AS role FROM customer UNION ALL SELECT -7, 'owner'),
n AS (SELECT source_id, count(*) FILTER (record_class = 'fact') AS facts, count(*) FILTER (record_class = 'rule') AS rules FROM recs WHERE status IN ('approved', 'published', 'conflicted') GROUP BY 1),
s AS (SELECT o_orderkey AS source_id, CASE WHEN o_orderstatus = 'P' THEN 'draft' ELSE 'published' END AS source_status FROM orders),
j AS (SELECT q.*, source_status, facts, rules, CASE WHEN source_status IS NULL THEN 'source_not_found' WHEN role NOT IN ('owner', 'manager') THEN 'permission_denied' END AS reason FROM q LEFT JOIN s USING (source_id) LEFT JOIN n USING (source_id))
SELECT source_id, role, reason, source_status AS previous_status, CASE WHEN reason IS NULL THEN 'deprecated' ELSE source_status END AS new_status,
  CASE WHEN reason IS NULL THEN coalesce(facts, 0) ELSE 0 END AS deprecated_facts, CASE WHEN reason IS NULL THEN coalesce(rules, 0) ELSE 0 END AS deprecated_rules FROM j""")
def source_rollbacks(t):
    asked = t("customer").select((F.col("c_custkey") * 3).alias("source_id"), _role(F.col("c_custkey")))
    asked = asked.union(asked.sparkSession.createDataFrame([(-7, "owner")], asked.schema))
    sources = t("orders").select(F.col("o_orderkey").alias("source_id"), F.when(F.col("o_orderstatus") == "P", "draft").otherwise("published").alias("source_status"))
    return V.rollbacks(_records(t), sources, asked)


@query("""
WITH j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'retrying' ELSE 'succeeded' END AS status FROM orders),
a AS (SELECT event_id % 1000 AS job_id, 'w' || user_id AS worker_id, ts AS tm FROM events)
SELECT job_id, 'running' AS status, arg_min(worker_id, (tm, worker_id)) AS worker_id, min(tm) AS started_at FROM j JOIN a USING (job_id) WHERE status IN ('queued', 'retrying') GROUP BY job_id""")
def job_claims(t):
    jobs = t("orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "retrying").otherwise("succeeded").alias("status"))
    return V.claims(jobs, t("events").select((F.col("event_id") % 1000).alias("job_id"), F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("worker_id"), F.col("ts").alias("at")))
