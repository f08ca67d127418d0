"""Queries over the read path: names of parts are asked for, a small index holds the corpus's terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import readpath as P
from .registry import query

#: user term, corpus term, entity, score, published
INDEX = [
    ("Widget", "standard widget", "e1", 0.9, True), ("cold  widget", "Chilled Widget", "e2", 0.95, True), ("bolt", "hex bolt m8", "e3", 0.7, True), ("bolt", "screw", "e0", 0.7, True), ("bolt", "rivet", "e9", 0.7, False),
    ("promo", "promotional", "e4", 0.5, True), ("small", "small", "e5", 0.4, True), ("", "nothing", "e6", 0.9, True), ("steel large", "x", "e7", 1.0, True), ("ring", "gasket", "e8", 0.2, False),
]


def _asked(t):
    key = F.col("p_partkey")
    text = F.concat(F.lit("  "), F.col("p_name"), F.when(key % 3 == 0, F.lit("\t ")).otherwise(F.lit(" ")), F.col("p_type"), F.lit(" "))
    return t("part").select(key.alias("query_id"), F.when(key % 50 != 0, text).alias("query"), F.when(key % 4 != 0, (key % 10) / 10).alias("recall"))


def _index(t):
    return t("region").sparkSession.createDataFrame(INDEX, "user_term string, corpus_term string, entity_id string, score double, published boolean")


def _made(t):
    return P.transformed(_asked(t), _index(t), corpus_id="parts", version="v1")


def _plain(text):
    return f"lower(trim(regexp_replace({text}, '\\s+', ' ', 'g')))"


_WITH = "CASE WHEN {u} = '' OR NOT contains({q}, {u}) THEN CASE WHEN contains({q}, {c}) THEN {q} ELSE {q} || ' ' || {c} END ELSE replace({q}, {u}, {c}) END"
_VALUES = ", ".join(f"({_plain(repr(u))}, {_plain(repr(c))}, '{e}', {s}, {str(p).lower()})" for u, c, e, s, p in INDEX)
MADE = f"""
ix AS (SELECT * FROM (VALUES {_VALUES}) AS x(u, c, e, score, published)),
q AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 50 = 0 THEN '' ELSE {_plain("p_name || CASE WHEN p_partkey % 3 = 0 THEN chr(9) || ' ' ELSE ' ' END || p_type")} END AS rewritten,
  CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 10) / 10 END AS recall FROM part),
m AS (SELECT query_id, rewritten, u, c, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, e, c, u) AS k FROM q JOIN ix ON published AND u <> '' AND contains(' ' || rewritten || ' ', ' ' || u || ' ')),
f AS (SELECT query_id, 0::BIGINT AS k, rewritten AS text FROM q UNION ALL SELECT f.query_id, m.k, {_WITH.format(q='f.text', u='m.u', c='m.c')} FROM f JOIN m ON m.query_id = f.query_id AND m.k = f.k + 1),
a AS (SELECT query_id, k, {_plain(_WITH.format(q='rewritten', u='u', c='c'))} AS alt, rewritten FROM m),
al AS (SELECT query_id, list(alt ORDER BY k) AS alternatives FROM (SELECT query_id, alt, min(k) AS k FROM a WHERE alt <> rewritten AND alt <> '' GROUP BY 1, 2) GROUP BY 1),
made AS (SELECT q.query_id, q.rewritten, {_plain('arg_max(f.text, f.k)')} AS grounded, q.recall FROM q JOIN f ON f.query_id = q.query_id GROUP BY q.query_id, q.rewritten, q.recall)"""


@query(f"""
WITH RECURSIVE {MADE}
SELECT query_id, rewritten, grounded, array_to_string(CASE WHEN recall < 0.5 THEN coalesce(alternatives, []) ELSE [] END, '|') AS alternatives, 'parts:v1:published:' || rewritten AS cache_key FROM made LEFT JOIN al USING (query_id)""")
def grounded_queries(t):
    return _made(t).withColumn("alternatives", F.array_join("alternatives", "|"))


@query(f"""
WITH RECURSIVE {MADE}
SELECT query_id // 5 AS plan_id, CASE WHEN query_id % 7 = 0 THEN 'named' ELSE 's' || (query_id % 5 + 1) END AS step_id, CASE WHEN query_id % 6 = 0 THEN 'GRAPH' ELSE 'SEMANTIC' END AS strategy, grounded AS query, query_id % 8 <> 0 AS required,
  CASE WHEN query_id % 9 = 0 THEN 2 ELSE 4 END AS max_chunks, CASE WHEN query_id % 9 <> 0 THEN 2400 END AS max_tokens, 'parts:v1:published:' || rewritten AS cache_key FROM made""")
def plan_steps(t):
    key = F.col("query_id")
    drafts = _asked(t).select(
        F.floor(key / 5).alias("plan_id"), (key % 5).alias("position"), "query_id", F.when(key % 7 == 0, "named").alias("step_id"), F.when(key % 6 == 0, "GRAPH").alias("strategy"), F.when(key % 8 == 0, False).alias("required"),
        F.when(key % 9 == 0, 2).alias("max_chunks"), F.lit(None).cast("int").alias("max_tokens"),
    )
    return P.steps(drafts, _made(t))


@query("""
SELECT coalesce(avg((quantity <= 25)::INT), 0) AS recall_at_k, coalesce(avg(round(8 / n) / 8), 0) AS mrr, coalesce(avg(discount), 0) AS citation_accuracy, coalesce(avg((flag = 'A')::INT), 0) AS abstention_correctness
FROM (SELECT l_quantity::DOUBLE AS quantity, l_linenumber AS n, round(l_discount::DOUBLE * 8) / 8 AS discount, l_returnflag AS flag FROM lineitem)""")
def golden_report(t):
    cases = t("lineitem").select((F.col("l_quantity") <= 25).cast("int").alias("recall_at_k"), (F.round(8 / F.col("l_linenumber")) / 8).alias("mrr"), (F.round(F.col("l_discount").cast("double") * 8) / 8).alias("citation_accuracy"), (F.col("l_returnflag") == "A").cast("int").alias("abstention_correctness"))
    return P.golden_report(cases)


@query("""
SELECT c_custkey AS label_id, o_comment AS query, 'c' || c_custkey AS expected_chunk_ids, c_name AS expected_quotes, o_orderpriority AS expected_verdict, CASE WHEN o_comment IS NULL THEN 'label_not_found' END AS reason
FROM customer LEFT JOIN (SELECT o_orderkey, o_orderstatus || '?' AS o_comment, o_orderpriority FROM orders) ON o_orderkey = c_custkey""")
def golden_cases(t):
    labels = t("orders").select(F.col("o_orderkey").alias("label_id"), F.concat("o_orderstatus", F.lit("?")).alias("query"), F.col("o_orderpriority").alias("verdict"))
    reviews = t("customer").select(F.col("c_custkey").alias("label_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("chunk_ids"), F.col("c_name").alias("quotes"))
    return P.promoted(labels, reviews)
