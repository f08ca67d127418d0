"""Queries over what a bundle shows: line items and orders are the records of controlled documents, customers their evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import publicrows as P
from .catalog_records import _pick
from .registry import query

KINDS = ["controlled_document_metadata", "industrial_requirement", "industrial_relation", "service_price"]
GAPS = [(1, "missing_revision", "open"), (2, "ocr_required", "closed"), (3, "quality_gate_failed", None), (4, "unheard_of", "open"), (5, "missing_revision", "needs_review")]
NOTES = ["all well", "see /home/ana/report", "Bearer abc.def", "password=1", "raw prompt kept", "C:\\Users\\x", "sk-abcdefghijklmnop1234", "api_key of the shop"]


def _records(t):
    key = F.col("o_orderkey")
    code = F.when(key % 10 != 0, F.concat(F.lit("POP-"), (F.col("o_custkey") % 50).cast("string"))).otherwise("")
    status = F.when(key % 17 == 0, "Obsolete").otherwise("vigent")
    content = F.to_json(F.struct(code.alias("document_code"), F.when(key % 6 != 0, "02").alias("revision"), F.struct(status.alias("status")).alias("state"), _pick(NOTES, key % 8).alias("note"), F.lit("9").alias("supplier_price")))
    ends = F.to_json(F.struct(F.concat(F.lit("POP-"), (key % 60).cast("string")).alias("from_id"), F.lit("POP-1").alias("to_id")))
    kind = _pick(KINDS, key % 4)
    spans = F.array(*[F.concat(F.lit("e"), (x % 200).cast("string")) for x in (key, F.col("o_custkey"), key)])
    return t("orders").select(
        key.cast("string").alias("id"), F.when(key % 4 != 2, kind).alias("fact_type"), F.when(key % 4 == 2, kind).alias("rule_type"), content.alias("normalized_content"), F.when(key % 4 == 2, ends).alias("condition"), F.lit(None).cast("string").alias("action"),
        F.when(key % 3 == 0, F.concat(F.lit("e"), (key % 90).cast("string"))).alias("evidence_span_id"), F.when(key % 5 != 0, spans).alias("evidence_span_ids"), F.when(key % 7 != 0, _pick(["published", "draft"], key % 2)).alias("status"), F.lit("hidden").alias("internal"),
    )


def _evidence(t):
    key = F.col("c_custkey")
    quote = F.when(key % 30 == 0, F.repeat(F.lit("long quote "), 60)).otherwise(F.concat("c_name", F.lit(": "), _pick(NOTES, key % 8)))
    return t("customer").select(F.concat(F.lit("e"), key.cast("string")).alias("id"), quote.alias("quote"), (key % 9).alias("page_number"))


_NOTE = "([" + ", ".join(f"'{x}'" for x in NOTES) + "])"
RECORDS = f"""
r AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS id, ({KINDS})[(o_orderkey % 4 + 1)::INT] AS kind, CASE WHEN o_orderkey % 10 <> 0 THEN 'POP-' || (o_custkey % 50) ELSE '' END AS code, o_orderkey % 6 <> 0 AS revised, o_orderkey % 17 = 0 AS obsolete,
  'POP-' || (o_orderkey % 60) AS from_id, CASE WHEN o_orderkey % 3 = 0 THEN 'e' || (o_orderkey % 90) END AS one, CASE WHEN o_orderkey % 5 <> 0 THEN ['e' || (o_orderkey % 200), 'e' || (o_custkey % 200), 'e' || (o_orderkey % 200)] END AS many,
  CASE WHEN o_orderkey % 7 <> 0 THEN ['published', 'draft'][(o_orderkey % 2 + 1)::INT] END AS status, {_NOTE}[(o_orderkey % 8 + 1)::INT] AS note FROM orders),
named AS (SELECT id, span, min(pos) AS pos FROM (SELECT id, one AS span, 0 AS pos FROM r WHERE one IS NOT NULL UNION ALL SELECT id, unnest(many), unnest([1, 2, 3]) FROM r WHERE many IS NOT NULL) GROUP BY 1, 2)"""
_PRIVATE = "(lower({x}) LIKE '%password=%' OR lower({x}) LIKE '%raw prompt%' OR regexp_matches({x}, '(^|\\s)/(Users|home|root)/') OR regexp_matches({x}, '\\bBearer\\s+[A-Za-z0-9._~+/=-]+') OR regexp_matches({x}, '\\b[A-Za-z]:\\\\Users\\\\') OR regexp_matches({x}, '\\bsk-[A-Za-z0-9_-]{{16,}}\\b'))"


@query(f"""
WITH {RECORDS} SELECT id, CASE WHEN kind <> 'industrial_relation' THEN kind END AS fact_type,
  '{{"document_code":' || to_json(code) || ',"note":' || CASE WHEN {_PRIVATE.format(x='note')} THEN 'null' ELSE to_json(note) END || CASE WHEN revised THEN ',"revision":"02"' ELSE '' END || ',"state":{{"status":"' || CASE WHEN obsolete THEN 'Obsolete' ELSE 'vigent' END || '"}}}}' AS normalized_content
FROM r WHERE status IS NULL OR status = 'published'""")
def safe_records(t):
    rows = P.public_columns(P.safe_records(P.shown(_records(t))), "fact")
    return rows.select("id", "fact_type", "normalized_content")


@query(f"""
WITH {RECORDS}, there AS (SELECT n.id, span, pos FROM named n WHERE span[2:]::INT BETWEEN 0 AND (SELECT max(c_custkey) FROM customer))
SELECT r.id, coalesce(string_agg(span, ',' ORDER BY pos), '') AS evidence_span_ids FROM r LEFT JOIN there USING (id) GROUP BY r.id""")
def record_evidence_ids(t):
    return P.with_evidence_ids(_records(t), _evidence(t)).select("id", F.array_join("evidence_span_ids", ",").alias("evidence_span_ids"))


@query(f"""
WITH {RECORDS}, e AS (SELECT 'e' || c_custkey AS id, CASE WHEN c_custkey % 30 = 0 THEN repeat('long quote ', 60) ELSE c_name || ': ' || {_NOTE}[(c_custkey % 8 + 1)::INT] END AS q, c_custkey % 9 AS page_number FROM customer)
SELECT id, CASE WHEN q LIKE '%api_key%' OR {_PRIVATE.format(x='q')} THEN NULL WHEN length(q) > 500 THEN left(q, 497) || '...' ELSE q END AS quote, page_number FROM e WHERE id IN (SELECT span FROM named)""")
def bundle_evidence(t):
    return P.public_columns(P.referenced_evidence(_records(t), _evidence(t)), "evidence")


@query(f"""
WITH {RECORDS}, mine AS (SELECT *, kind = 'controlled_document_metadata' AS meta, kind = 'industrial_relation' AS rel FROM r WHERE kind <> 'service_price'),
nodes AS (SELECT DISTINCT code FROM r WHERE kind <> 'industrial_relation' AND code <> ''),
g AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{n}', {repr(s) if s else 'NULL'})" for k, n, s in GAPS)}) AS x(id, kind, status) WHERE status IS NULL OR status IN ('open', 'needs_review', 'blocked')),
b AS (SELECT 'industrial_metadata_missing_document_code' AS blocker FROM mine WHERE meta AND code = '' UNION ALL SELECT 'industrial_metadata_missing_revision' FROM mine WHERE meta AND NOT revised
  UNION ALL SELECT 'industrial_obsolete_record_active' FROM mine WHERE NOT meta AND obsolete UNION ALL SELECT 'industrial_relation_missing_node' FROM mine WHERE rel AND (from_id NOT IN (SELECT code FROM nodes) OR 'POP-1' NOT IN (SELECT code FROM nodes))
  UNION ALL SELECT CASE kind WHEN 'missing_revision' THEN 'industrial_metadata_missing_revision' WHEN 'quality_gate_failed' THEN 'industrial_quality_gate_failed' END FROM g WHERE kind IN ('missing_revision', 'quality_gate_failed'))
SELECT blocker, count(*) AS hits FROM b GROUP BY 1""")
def bundle_blockers(t):
    gaps = t("region").sparkSession.createDataFrame(GAPS, "id long, kind string, status string")
    return P.industrial_blockers(_records(t), gaps)


@query("SELECT c_custkey AS id, sha256(c_name || chr(31) || '[' || c_custkey || ']' || CASE WHEN c_custkey % 2 = 0 THEN chr(31) || 'x' ELSE '' END) AS pack_hash FROM customer")
def pack_hashes(t):
    key = F.col("c_custkey")
    return t("customer").select(key.alias("id"), P.pack_hash(F.col("c_name"), F.concat(F.lit("["), key.cast("string"), F.lit("]")), F.when(key % 2 == 0, "x").otherwise("")).alias("pack_hash"))
