"""Queries over nested JSON and over expectations; parts carry the JSON, documents and their labels the cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import trees as T
from ..operators import evaluation as E
from .registry import query

_JSON = """'{"zone": {"b": {"c": {"d": {"e": ' || p_size || ', "name": "' || p_brand || '"}}}}, "list": [{"x": ' || p_partkey || '}, "two", [true, {"y": null, "text": "deep ]}"}]], "value": "' || p_type || '", "none": {}, "name": "n"}'"""
#: The same leaves in the order of their canonical text: name, value, list, none, zone.
_TEXT = "'n ' || p_type || ' ' || p_partkey || ' two True deep ]} ' || p_brand || ' ' || p_size"


def _json(t):
    return t("part").select(F.col("p_partkey").alias("id"), F.expr(_JSON).alias("doc"))


@query(f"""
SELECT p_partkey AS id, ltrim(fullkey, '$.') AS path, CASE WHEN type = 'NULL' THEN '' WHEN type = 'BOOLEAN' THEN CASE WHEN atom::VARCHAR = 'true' THEN 'True' ELSE 'False' END ELSE atom->>'$' END AS value
FROM (SELECT p_partkey, t.* FROM (SELECT p_partkey, {_JSON} AS doc FROM part), json_tree(doc::JSON) AS t) WHERE type NOT IN ('OBJECT', 'ARRAY')""")
def json_leaves(t):
    return T.leaves(_json(t), "doc").select("id", "path", T.leaf_text(F.col("value")).alias("value"))


@query(f"SELECT p_partkey AS id, {_TEXT} AS canonical FROM part")
def json_canonical(t):
    return T.canonical_text(_json(t), "doc", "id")


_CASES = """c AS (SELECT d.*, quality, CASE WHEN quality = 1 THEN 'passed' ELSE 'failed' END AS expected, CASE WHEN n_chars > 1000 THEN 'passed' ELSE 'failed' END AS actual FROM documents d JOIN labels USING (doc_id))"""


def _cases(t):
    rows = t("documents").join(t("labels"), "doc_id")
    return rows.withColumns({"expected": F.when(F.col("quality") == 1, "passed").otherwise("failed"), "actual": F.when(F.col("n_chars") > 1000, "passed").otherwise("failed")})


@query(f"""
WITH {_CASES}, k AS (SELECT CASE WHEN doc_id % 7 > 0 THEN lang END AS modality, expected, actual FROM c)
SELECT modality, cases, false_pass, false_fail, CASE WHEN must_pass = 0 THEN 0 ELSE false_fail / must_pass END::DOUBLE AS false_fail_rate, (correct / cases)::DOUBLE AS accuracy FROM
  (SELECT coalesce(modality, 'unspecified') AS modality, count(*) AS cases, count(*) FILTER (expected = 'failed' AND actual = 'passed') AS false_pass, count(*) FILTER (expected = 'passed' AND actual = 'failed') AS false_fail,
    count(*) FILTER (expected = 'passed') AS must_pass, count(*) FILTER (expected = actual) AS correct FROM k GROUP BY 1
   UNION ALL SELECT NULL, count(*), count(*) FILTER (expected = 'failed' AND actual = 'passed'), count(*) FILTER (expected = 'passed' AND actual = 'failed'), count(*) FILTER (expected = 'passed'), count(*) FILTER (expected = actual) FROM k)""")
def confusion_by_modality(t):
    return E.confusion(_cases(t).select(F.when(F.col("doc_id") % 7 > 0, F.col("lang")).alias("modality"), "expected", "actual"))


@query("""
WITH truth AS (SELECT source, lang, quality FROM documents JOIN labels USING (doc_id) WHERE doc_id % 9 = 0)
SELECT doc_id, source, lang, quality FROM (SELECT doc_id, source, lang, (n_chars > 1000)::INT AS quality FROM documents) p
WHERE EXISTS (SELECT 1 FROM truth WHERE truth.source = p.source AND truth.lang = p.lang AND truth.quality = p.quality)""")
def scoped_predictions(t):
    truth = t("documents").join(t("labels"), "doc_id").where("doc_id % 9 = 0").select("source", "lang", "quality")
    found = t("documents").select("doc_id", "source", "lang", (F.col("n_chars") > 1000).cast("int").alias("quality"))
    return E.scoped(found, truth, ["source", "lang", "quality"]).select("doc_id", "source", "lang", "quality")


_CODES = {"pipe": r"\|", "digits": r"[0-9]{4}", "sign": r"[#$%]"}


@query(f"""
WITH e AS (SELECT doc_id, lang, text, unnest({list(_CODES)}) AS code, unnest([{', '.join(f"'{x}'" for x in _CODES.values())}]) AS pattern FROM documents),
j AS (SELECT lang, code, doc_id % 2 = 0 AS negative, regexp_matches(coalesce(text, ''), pattern) <> (doc_id % 2 = 0) AS met FROM e)
SELECT lang, code, count(*) FILTER (NOT negative) AS positives, count(*) FILTER (NOT negative AND met) AS hits, count(*) FILTER (negative) AS negatives, count(*) FILTER (negative AND met) AS passes FROM j GROUP BY lang, code""")
def expectations_met(t):
    docs = t("documents")
    codes = F.array(*[F.lit(x) for x in _CODES])
    expected = docs.select(F.col("doc_id").alias("key"), "lang", F.explode(codes).alias("code"), (F.col("doc_id") % 2 == 0).alias("negative"))
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), c) for c, p in _CODES.items()]))
    return E.expectations(expected, docs.select(F.col("doc_id").alias("key"), F.explode(found).alias("code")), ["lang", "code"])
