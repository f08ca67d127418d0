"""Queries over payloads of records: every part carries one of the listed payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import payloads as P
from .registry import query

CASES = [
    ("service_price", '{"service_name": "corte", "price_amount": 80, "price_type": "fixed"}'),
    ("service_price", '{"service_name": "corte", "price_amount": "R$ 1.250,50", "price_type": "fixed", "currency": "BRL"}'),
    ("service_price", '{"service_name": 7, "price_amount": true, "price_type": "cheap", "currency": null, "color": "red", "min_price": "caro"}'),
    ("service_price", '{}'), ("service_price", 'no json'), ("service_price", None), ("service_price", '[1]'), ("weather", '{"a": 1}'), (None, '{"a": 1}'),
    ("business_hours", '{"day_of_week": "mon", "open_time": "9h", "close_time": "fim do dia", "is_closed": false}'),
    ("business_hours", '{"day_of_week": "monday", "is_closed": "no", "special_case": null, "open_time": "nunca"}'),
    ("payment_method", '{"method": "pix", "accepted": true, "conditions": null}'), ("payment_method", '{"method": null, "accepted": 1}'),
    ("discount_rule", '{"condition": {"payment_method": "pix"}, "action": {"discount_percentage": "10,5 %", "discount_fixed": "R$ 5"}}'),
    ("discount_rule", '{"condition": {"min_value": 10.5, "x": 1}, "action": {"discount_percentage": 10}, "y": 2}'),
    ("discount_rule", '{"condition": "pix", "action": null}'), ("discount_rule", '{"condition": {}, "action": {"discount_fixed": [1]}}'),
    ("cancellation_policy", '{"notice_required_hours": 24, "penalty_percentage": "50%", "penalty_fixed": "30"}'), ("cancellation_policy", '{"penalty_fixed": 1e2}'),
    ("contact_info", '{"phone": "11", "email": null}'), ("contact_info", '{"phone": 11, "fax": "1"}'), ("faq_item", '{"question": "q?", "answer": ""}'), ("faq_item", '{"question": "q?", "answer": {"a": "b"}}'),
    ("controlled_document_metadata", '{"document_code": "POP-1", "document_type": " politica ", "title": "t", "revision": "02", "status": "Vigente", "owner_area": "qa", "approvers": ["a", "b"], "confidentiality": "Público"}'),
    ("controlled_document_metadata", '{"document_code": "POP-1", "document_type": "novel", "title": "t", "revision": 2, "status": "ok", "owner_area": "qa", "approvers": ["a", 1], "allowed_audience": null, "confidentiality": null}'),
    ("controlled_document_metadata", '{"approvers": [], "allowed_audience": "all", "issue_date": "2024-01-01"}'),
    ("industrial_requirement", '{"requirement_type": "training", "subject": "s", "requirement": "r", "applies_to": "x"}'), ("industrial_responsibility", '{"role": "r", "responsibility": false}'),
    ("industrial_relation", '{"from_id": "a", "from_type": "Role", "to_id": "b", "to_type": "Planet", "relationship_type": "supersedes"}'),
]


def _cases(t):
    spark = t("region").sparkSession
    cases = spark.createDataFrame([(k, *c) for k, c in enumerate(CASES)], "k long, fact_type string, payload string")
    return t("part").select(F.col("p_partkey").alias("id"), "p_name", (F.col("p_partkey") % len(CASES)).alias("k")).join(F.broadcast(cases), "k")


def _quoted(x):
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


CASES_SQL = f"""cases AS (SELECT * FROM (VALUES {', '.join(f'({k}, {_quoted(a)}, {_quoted(b)})' for k, (a, b) in enumerate(CASES))}) AS x(k, fact_type, payload)),
rows_ AS (SELECT p_partkey AS id, p_name, k, fact_type, CASE WHEN json_valid(payload) AND payload LIKE '{{%' THEN payload::JSON END AS doc, payload FROM part JOIN cases ON k = p_partkey % {len(CASES)})"""


def _fields():
    """``fact_type, path, parent, kind, choices, required, nullable, position`` of every field."""
    out = []
    for kind, fields in P.TYPES.items():
        todo = [("", f) for f in fields]
        while todo:
            parent, (name, form, required) = todo.pop(0)
            path, nested = f"{parent}{name}", isinstance(form, list) and isinstance(form[0], tuple)
            shape = form if isinstance(form, str) else "object" if nested else "choice"
            names = form if shape == "choice" else []
            alias = P.ALIASES.get(path, {}) if shape == "choice" else {}
            out.append(f"('{kind}', '{path}', '{parent[:-1]}', '{shape}', {names or '[]'}::VARCHAR[], {required}, {not required and name not in P.NOT_NULL}, {[a for a, b in alias.items() if b in names] or '[]'}::VARCHAR[])")
            if nested:
                todo += [(f"{path}.", f) for f in form]
    return ", ".join(out)


_FOLD = "translate(lower(trim(json_extract_string(doc, '$.' || path))), 'çãáàâéêíóôõú', 'caaaaeeiooou')"


@query(f"""
WITH {CASES_SQL}, spec AS (SELECT * FROM (VALUES {_fields()}) AS x(fact_type, path, parent, kind, choices, required, nullable, aliases)),
f AS (SELECT id, path, parent, kind, required, nullable, json_type(doc, '$.' || path) AS ty, (parent = '' OR json_type(doc, '$.' || nullif(parent, '')) = 'OBJECT') AS inside,
  list_contains(choices, json_extract_string(doc, '$.' || path)) OR list_contains(aliases, {_FOLD}) AS chosen,
  len(list_filter(CASE WHEN json_type(doc, '$.' || path) = 'ARRAY' THEN json_extract(doc, '$.' || path)::JSON[] END, lambda x: json_type(x) <> 'VARCHAR')) > 0 AS mixed FROM rows_ JOIN spec USING (fact_type) WHERE doc IS NOT NULL),
e AS (SELECT id, path || ': missing' AS err FROM f WHERE inside AND required AND ty IS NULL
  UNION ALL SELECT id, path || ': ' || CASE kind WHEN 'text' THEN 'string_type' WHEN 'number' THEN 'float_type' WHEN 'flag' THEN 'bool_type' WHEN 'texts' THEN 'list_type' WHEN 'object' THEN 'model_type' ELSE 'literal_error' END
    FROM f WHERE inside AND ty IS NOT NULL AND NOT (ty = 'NULL' AND nullable) AND NOT CASE kind WHEN 'text' THEN ty = 'VARCHAR' WHEN 'number' THEN ty IN ('BIGINT', 'UBIGINT', 'DOUBLE') WHEN 'flag' THEN ty = 'BOOLEAN' WHEN 'texts' THEN ty = 'ARRAY' WHEN 'object' THEN ty = 'OBJECT' ELSE ty = 'VARCHAR' AND coalesce(chosen, false) END
  UNION ALL SELECT id, path || ': string_type' FROM f WHERE kind = 'texts' AND ty = 'ARRAY' AND mixed
  UNION ALL SELECT id, key || ': extra_forbidden' FROM (SELECT id, fact_type, unnest(json_keys(doc)) AS key FROM rows_ WHERE doc IS NOT NULL) k WHERE fact_type IN (SELECT fact_type FROM spec) AND NOT EXISTS (SELECT 1 FROM spec s WHERE s.fact_type = k.fact_type AND s.path = k.key)
  UNION ALL SELECT id, parent || '.' || key || ': extra_forbidden' FROM (SELECT id, r.fact_type, path AS parent, unnest(json_keys(doc, '$.' || path)) AS key FROM rows_ r JOIN spec s ON s.fact_type = r.fact_type AND s.kind = 'object' AND json_type(doc, '$.' || path) = 'OBJECT') k
    WHERE NOT EXISTS (SELECT 1 FROM spec s WHERE s.fact_type = k.fact_type AND s.path = k.parent || '.' || k.key)
  UNION ALL SELECT id, 'payload: not_an_object' FROM rows_ WHERE doc IS NULL UNION ALL SELECT id, 'fact_type: unknown' FROM rows_ WHERE doc IS NOT NULL AND (fact_type IS NULL OR fact_type NOT IN (SELECT fact_type FROM spec)))
SELECT r.id, r.fact_type, count(err) = 0 AS valid, coalesce(string_agg(err, '|' ORDER BY err), '') AS errors FROM rows_ r LEFT JOIN e USING (id) GROUP BY 1, 2""")
def payload_checks(t):
    judged = _cases(t).withColumn("errors", F.array_sort(P.errors(F.col("fact_type"), F.col("payload"))))
    return judged.select("id", "fact_type", (F.size("errors") == 0).alias("valid"), F.array_join("errors", "|").alias("errors"))


_READS = ", ".join(f"('{kind}', '{path}', '{form}')" for form, fields in (("money", P.MONEY_FIELDS), ("percent", P.PERCENT_FIELDS), ("time", P.TIME_FIELDS)) for kind, paths in fields.items() for path in paths)


@query(rf"""
WITH {CASES_SQL}, f AS (SELECT id, path, form, lower(trim(json_extract_string(doc, '$.' || path))) AS s FROM rows_ JOIN (VALUES {_READS}) AS x(fact_type, path, form) USING (fact_type) WHERE json_type(doc, '$.' || path) = 'VARCHAR'),
v AS (SELECT id, path, CASE form
  WHEN 'money' THEN CASE WHEN regexp_matches(s, '\d') THEN (replace(regexp_extract(s, '{V.MONEY}', 1), '.', '') || '.' || coalesce(nullif(regexp_extract(s, '{V.MONEY}', 2), ''), '00'))::DOUBLE::VARCHAR END
  WHEN 'percent' THEN CASE WHEN regexp_matches(replace(s, ',', '.'), '{V.PERCENT}') THEN regexp_extract(replace(s, ',', '.'), '{V.PERCENT}', 1)::DOUBLE::VARCHAR END
  ELSE CASE s {' '.join(f"WHEN '{word}' THEN '{value}'" for word, value in V.VAGUE_TIMES.items())} ELSE CASE WHEN regexp_matches(s, '{V.TIME}') THEN
    lpad(regexp_extract(s, '{V.TIME}', 1), 2, '0') || ':' || lpad(regexp_extract(s, '{V.TIME}', 2), 2, '0') END END END AS value FROM f)
SELECT id, path, value FROM v WHERE value IS NOT NULL""")
def payload_normalised(t):
    made = _cases(t).select("id", F.explode(P.normalised(F.col("fact_type"), F.col("payload"))).alias("path", "value"))
    return made


def _shown(path: str) -> str:
    at = f"json_extract(doc, '$.' || {path})::VARCHAR"
    said = f"json_extract_string(doc, '$.' || {path})"
    return f"""CASE json_type(doc, '$.' || {path}) WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN upper(left({said}, 1)) || substr({said}, 2)
  WHEN 'OBJECT' THEN replace(replace(replace({at}, '":', '": '), ',"', ', "'), '"', chr(39))
  WHEN 'ARRAY' THEN replace('[' || array_to_string(list_transform(json_extract(doc, '$.' || {path})::JSON[], lambda x: x::VARCHAR), ', ') || ']', '"', chr(39)) ELSE {said} END"""


_SAYS = "CASE WHEN {0} NOT IN ('', 'None', 'False', '0', '0.0', '{{}}', '[]') THEN {0} END"


@query(f"""
WITH {CASES_SQL}, s AS (SELECT id, p_name, doc, coalesce({', '.join(_SAYS.format(_shown(f"'{x}'")) for x in ('service', 'service_name', 'name'))}) AS service,
  coalesce({', '.join(_SAYS.format(_shown(f"'{x}'")) for x in ('price', 'price_amount'))}) AS price FROM rows_),
k AS (SELECT id, doc, unnest(json_keys(doc)) AS key, generate_subscripts(json_keys(doc), 1) AS i FROM rows_ WHERE doc IS NOT NULL),
l AS (SELECT id, string_agg(key || ': ' || {_shown('key')}, ', ' ORDER BY i) AS listed FROM k GROUP BY id)
SELECT id, CASE WHEN service IS NOT NULL AND price IS NOT NULL THEN service || ': ' || price ELSE coalesce(listed, p_name) END AS rendered FROM s LEFT JOIN l USING (id)""")
def facts_rendered(t):
    return _cases(t).select("id", P.rendered(F.col("payload"), F.col("p_name")).alias("rendered"))


@query("""
WITH e AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'discount_rule' ELSE 'cancellation_policy' END AS kind,
  CASE c_custkey % 3 WHEN 0 THEN '{"x": ' || c_custkey || '}' WHEN 1 THEN '{"notice_required_hours": ' || c_nationkey || '}' ELSE '{}' END AS condition,
  CASE c_custkey % 3 WHEN 0 THEN '{"discount_fixed": 5}' WHEN 1 THEN CASE WHEN c_acctbal < 0 THEN '{"penalty_fixed": "' || c_name || '"}' ELSE '{"penalty_fixed": 3.5}' END ELSE '{"penalty_fixed": "3"}' END AS action FROM customer),
f AS (SELECT id, 'condition.' || unnest(json_keys(condition)) AS path, 'extra_forbidden' AS code FROM e WHERE kind = 'discount_rule'
  UNION ALL SELECT id, 'notice_required_hours', 'missing' FROM e WHERE kind <> 'discount_rule' AND json_extract(condition, '$.notice_required_hours') IS NULL
  UNION ALL SELECT id, 'penalty_fixed', 'float_type' FROM e WHERE kind <> 'discount_rule' AND json_type(action, '$.penalty_fixed') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE'))
SELECT e.id, coalesce(string_agg(path || ': ' || code, '|' ORDER BY path || ': ' || code DESC), '') AS errors FROM e LEFT JOIN f USING (id) GROUP BY e.id""")
def rule_edits(t):
    key = F.col("c_custkey") % 3
    number = lambda before, c: F.concat(F.lit(before), F.col(c).cast("string"), F.lit("}"))
    kind = F.when(key == 0, "discount_rule").otherwise("cancellation_policy")
    condition = F.when(key == 0, number('{"x": ', "c_custkey")).when(key == 1, number('{"notice_required_hours": ', "c_nationkey")).otherwise("{}")
    fixed = F.when(F.col("c_acctbal") < 0, F.concat(F.lit('{"penalty_fixed": "'), F.col("c_name"), F.lit('"}'))).otherwise('{"penalty_fixed": 3.5}')
    action = F.when(key == 0, '{"discount_fixed": 5}').when(key == 1, fixed).otherwise('{"penalty_fixed": "3"}')
    return t("customer").select(F.col("c_custkey").alias("id"), F.array_join(F.reverse(F.array_sort(P.edit_errors(kind, condition, action))), "|").alias("errors"))
