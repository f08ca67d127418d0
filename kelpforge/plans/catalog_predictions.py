"""Queries over predictions and sources: parts carry facts, customers rules, orders unknown items, suppliers are the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import predictions as R
from ..sources.committed import shared_folder
from .registry import query

_NORMAL = """CASE WHEN p_partkey % 3 = 0 THEN '{}' ELSE '{"zone": {"b": ' || p_size || '}, "price": "' || p_brand || '", "service_name": "' || p_type || '"}' END"""
_PLAIN = """CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE '{"text": "' || p_brand || '", "name": "n"}' END"""
_IF = """CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '{"day": "' || c_mktsegment || '"}' END"""
_THEN = """CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE '{"discount": [' || c_custkey || ', "x"]}' END"""
_FACT = {
    "id": "p_partkey", "source_id": "p_partkey % 13", "fact_type": "p_brand", "content": _PLAIN, "normalized_content": _NORMAL, "evidence_quote": "CASE WHEN p_partkey % 12 = 0 THEN '' ELSE p_type END",
    "status": "CASE WHEN p_partkey % 5 = 0 THEN 'draft' ELSE 'published' END",
}
_RULE = {"id": "c_custkey", "source_id": "c_nationkey", "rule_type": "c_mktsegment", "condition": _IF, "action": _THEN, "evidence_quote": "''", "status": "CASE WHEN c_custkey % 7 = 0 THEN 'draft' ELSE 'published' END"}
_UNKNOWN = {
    "id": "o_orderkey", "source_id": "o_custkey % 17", "suggested_fact_type": "CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END", "metadata": """CASE WHEN o_orderkey % 3 = 0 THEN '{"reason": "no schema"}' END""",
    "status": "CASE o_orderkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'schema_requested' ELSE 'ignored' END",
}


def _columns(made):
    return [f"{sql} AS {name}" for name, sql in made.items()]


def _select(made, table):
    return f"SELECT {', '.join(_columns(made))} FROM {table}"


_REASON = "CASE WHEN metadata IS NOT NULL THEN 'no schema' ELSE coalesce(suggested_fact_type, 'unknown') END"


@query(f"""
WITH f AS ({_select(_FACT, "part")}), r AS ({_select(_RULE, "customer")}), u AS ({_select(_UNKNOWN, "orders")}), s AS (SELECT s_suppkey AS source_id, s_name AS file FROM supplier),
p AS (SELECT f.id, f.source_id, 'fact' AS record_kind, fact_type AS type, coalesce(content, '{{}}') AS content, normalized_content, CASE WHEN f.id % 3 <> 0 THEN p_type || ' ' || p_brand || ' ' || p_size WHEN content IS NULL THEN '' ELSE 'n ' || p_brand END AS canonical, evidence_quote, status
    FROM f JOIN part ON p_partkey = f.id WHERE status = 'published' AND (f.id % 3 <> 0 OR content IS NOT NULL OR evidence_quote <> '')
  UNION ALL SELECT r.id, source_id, 'rule', rule_type, '{{"condition":' || coalesce(condition, '{{}}') || ',"action":' || coalesce(action, '{{}}') || '}}', '{{}}', concat_ws(' ', CASE WHEN condition IS NOT NULL THEN rule_type END, CASE WHEN action IS NOT NULL THEN r.id || ' x' END), '', status
    FROM r WHERE status = 'published' AND (condition IS NOT NULL OR action IS NOT NULL)
  UNION ALL SELECT id, source_id, 'review_signal', 'unknown_facts_queue', json_object('reason', {_REASON}, 'suggested_fact_type', coalesce(suggested_fact_type, ''), 'status', status)::VARCHAR, '{{}}', {_REASON}, '', 'published' FROM u WHERE status <> 'ignored')
SELECT id::VARCHAR AS id, p.source_id::VARCHAR AS source_id, coalesce(file, '') AS source_filename, record_kind, type, content, normalized_content, canonical, evidence_quote, status FROM p LEFT JOIN s ON s.source_id = p.source_id""")
def predictions_exported(t):
    facts, rules = t("part").selectExpr(*_columns(_FACT)), t("customer").selectExpr(*_columns(_RULE))
    published = facts.where("status = 'published'")
    sources = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("original_filename"))
    return R.exported(R.live(published, facts), R.live(rules.limit(0), rules), t("orders").selectExpr(*_columns(_UNKNOWN)), sources)


@query("""
WITH k AS (SELECT l_suppkey AS source_id, 'chunks' AS x FROM lineitem UNION ALL SELECT o_custkey % 1000, 'jobs' FROM orders UNION ALL SELECT p_partkey % 1000, 'facts' FROM part)
SELECT source_id % 4 AS workspace_id, source_id, count(*) FILTER (x = 'chunks') AS chunks, count(*) FILTER (x = 'jobs') AS jobs, count(*) FILTER (x = 'facts') AS facts FROM k GROUP BY 1, 2""")
def source_reports(t):
    return R.source_counts(_tables(t), ["workspace_id", "source_id"])


def _tables(t):
    keyed = {"chunks": t("lineitem").select(F.col("l_suppkey").alias("source_id")), "jobs": t("orders").select((F.col("o_custkey") % 1000).alias("source_id")), "facts": t("part").select((F.col("p_partkey") % 1000).alias("source_id"))}
    return {name: rows.withColumn("workspace_id", F.col("source_id") % 4) for name, rows in keyed.items()}


@query("SELECT 'chunks' AS table_name, count(*) AS rows FROM lineitem WHERE l_suppkey = 7 UNION ALL SELECT 'jobs', count(*) FROM orders WHERE o_custkey % 1000 = 7 UNION ALL SELECT 'facts', count(*) FROM part WHERE p_partkey % 1000 = 7")
def source_report_pruned(t):
    """All tables clustered by source, then the report of one source read from its directories."""
    tables = _tables(t)
    spark = tables["jobs"].sparkSession
    store = R.Clustered(f"{shared_folder(spark)}/clustered-{uuid.uuid4().hex}", 16)
    for name, rows in tables.items():
        store.write(name, rows)
    return store.report(spark, list(tables), 3, 7)
