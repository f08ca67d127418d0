"""Queries over a compiled pack: customers are the rows of its tables, documents the sections of its texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compiling as C
from ..operators import packs as P
from .catalog_records import _uuid_sql
from .registry import query

_TABLES = ["04_allergens_excipients_triage.csv", "14_known_gaps_and_publish_gates.csv", "17_sample_user_queries.csv", "30_price_catalog.csv", "40_quote_rules_matrix.csv", "53_tool_calling_policy_matrix.csv", "60_units.csv"]
_TEXTS = ["05_sales_triage_rules.md", "13_prescription_document_handling.md", "16_memory_and_tool_policy.md", "43_payment_discount_gap_policy.md", "63_release_gate_eval_suite.md"]
_ASKED = ["create_quote", "handoff_to_human", "new_tool", ""]
_STATES = ["open", "closed", "accepted"]

#: The cells of a row, named in order.
_DATA = {
    "case_id": "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(c_name, ' case') END", "evidence_anchor": "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('a', c_custkey % 90) END", "summary": "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('gap of ', c_name, ' password=') END",
    "trigger": "CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END", "severity": "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE lower(c_mktsegment) END", "user_query": "concat(c_name, ' asks /home/me/x now')", "forbidden_behavior": "concat('a; b |', c_mktsegment, ',,c')",
    "allowed_followup_tools": "concat(c_mktsegment, ';x')", "expected_final_action": "CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'hand over' END",
}


def _listed(values):
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def _clean(x):
    x = rf"regexp_replace(regexp_replace({x}, '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+', '[redacted]', 'g'), '(?i)\b(?:sk|pk|rk|sb|org|proj)-[A-Za-z0-9_-]{{16,}}\b', '[redacted]', 'g')"
    x = rf"regexp_replace({x}, '(?i)(^|[^A-Za-z0-9])/(?:Users|home|root)/[^\s,;)]*', '\1[redacted]', 'g')"
    for mark in T.FORBIDDEN_MARKERS:
        x = f"replace({x}, '{mark}', '[redacted]')"
    return x


def _quote(x):
    cut = f"regexp_replace(regexp_replace(substr({x}, 1, {P.MAX_QUOTE}), '{P.PRIVATE_PATH}', '[REDACTED_PATH]', 'g'), '{P.SECRET}', '[REDACTED_SECRET]', 'g')"
    return rf"regexp_replace({cut}, '^\s+|\s+$', '', 'g')"


_CELLS = ", ".join(f"({sql}) AS {name}" for name, sql in _DATA.items())
_JSON = "json_object(" + ", ".join(f"'{n}', {_clean(n)}" for n in [*_DATA, "status", "required_first_tool"]) + ")::VARCHAR"
_FILLED = "array_to_string(list_filter([" + ", ".join([*_DATA, "status", "required_first_tool"]) + "], lambda x: x <> ''), ' | ')"
_ID = "CASE WHEN case_id <> '' THEN case_id ELSE 'row-' || n END"
_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
_PACK = rf"""
c AS (SELECT ({_listed(_TABLES)})[c_nationkey % {len(_TABLES)} + 1] AS f, c_custkey AS n, 'type-' || c_nationkey % 3 AS kind, {_CELLS}, ({_listed(_STATES)})[c_custkey % 3 + 1] AS status, ({_listed(_ASKED)})[c_custkey % 4 + 1] AS required_first_tool FROM customer),
r AS (SELECT *, {_uuid_sql("'evidence:' || f || ':row:' || n")} AS own, {_uuid_sql("'source:' || f")} AS src, {_ID} AS name, {_JSON} AS data, {_quote(_FILLED)} AS quote FROM c),
d AS (SELECT ({_listed(_TEXTS)})[doc_id % {len(_TEXTS)} + 1] AS f, doc_id AS n, 'Part ' || doc_id AS heading, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'See' || chr(10) || '#Rule ' || doc_id || chr(10) END || '#Evidence Anchors' || chr(10) || '- `a' || doc_id % 70 || '`' || chr(10) || text AS body FROM documents),
q AS (SELECT *, {_quote("heading || ': ' || substr(body, 1, 400)")} AS quote, {_uuid_sql("'source:' || f")} AS src FROM d),
s AS (SELECT *, {_uuid_sql(f"'evidence:' || f || ':' || {_SLUG.format('heading')}")} AS own, trim(regexp_extract(quote, '(?:^|\n)#+([^\n]*)', 1)) AS title FROM q),
a AS (SELECT anchor, coalesce(max_by(own, (f, n)) FILTER (k = 0), min_by(own, (f, n)) FILTER (k = 1)) AS by_anchor FROM
  (SELECT 0 AS k, f, n, own, evidence_anchor AS anchor FROM r WHERE evidence_anchor <> '' UNION ALL SELECT 1, f, n, own, regexp_extract(quote, '\n- `([^`]*)`', 1) FROM s) GROUP BY 1),
p AS (SELECT f, min_by(own, n) AS by_file FROM r GROUP BY 1),
l AS (SELECT r.*, coalesce(by_anchor, by_file) AS evidence_id FROM r LEFT JOIN a ON evidence_anchor <> '' AND evidence_anchor = anchor JOIN p USING (f))"""


def _pick(values, key):
    return F.get(F.array(*[F.lit(x) for x in values]), key.cast("int"))


def _rows(t):
    key = F.col("c_custkey")
    cells = {n: F.expr(sql) for n, sql in _DATA.items()} | {"status": _pick(_STATES, key % 3), "required_first_tool": _pick(_ASKED, key % 4)}
    data = F.create_map(*[x for n, v in cells.items() for x in (F.lit(n), v)])
    return t("customer").select(_pick(_TABLES, F.col("c_nationkey") % len(_TABLES)).alias("filename"), key.alias("row_number"), F.concat(F.lit("type-"), (F.col("c_nationkey") % 3).cast("string")).alias("document_type"), data.alias("data"))


def _sections(t):
    key = F.col("doc_id")
    head = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("See\n#Rule "), key.cast("string"), F.lit("\n")))
    body = F.concat(head, F.lit("#Evidence Anchors\n- `a"), (key % 70).cast("string"), F.lit("`\n"), F.coalesce("text", F.lit("")))
    return t("documents").select(_pick(_TEXTS, key % len(_TEXTS)).alias("filename"), key.alias("start_line"), F.concat(F.lit("Part "), key.cast("string")).alias("heading"), body.alias("body"))


def _links(t):
    return C.linked(_rows(t), _sections(t))


_FACT_FILES = f"f IN ({', '.join(repr(x) for x in (_TABLES[0], _TABLES[3], _TABLES[4], _TABLES[6]))})"
_FACTS = f"""SELECT {_uuid_sql("'fact:' || f || ':' || n || ':' || name")} AS id, CASE WHEN f LIKE '04%' THEN 'allergen_excipient' WHEN f LIKE '%price%' THEN 'price' ELSE replace(kind, '-', '_') END AS fact_type,
  '{{"source_file":"' || f || '","record_id":"' || name || '","document_type":"' || kind || '","data":' || data || '}}' AS content, 0.9::DOUBLE AS confidence, src AS source_id, evidence_id FROM l WHERE {_FACT_FILES}"""


@query(f"WITH {_PACK} {_FACTS}")
def compiled_facts(t):
    return C.facts(_links(t))


_CONDITION = """CASE WHEN "trigger" <> '' THEN json_object('trigger', "trigger")::VARCHAR ELSE json_object('match', data::JSON)::VARCHAR END"""
_ACTION = "CASE WHEN expected_final_action <> '' THEN json_object('expected_final_action', expected_final_action)::VARCHAR ELSE json_object('apply', data::JSON)::VARCHAR END"
_ORDER = {f: k for k, f in enumerate(C.RULE_FILES)}
_RULE_SQL = "map {" + ", ".join(f"'{f}': '{k}'" for f, k in C.RULE_FILES.items()) + "}"
_ORDER_SQL = "map {" + ", ".join(f"'{f}': {k}" for f, k in _ORDER.items()) + "}"
_RULES = f"""SELECT {_uuid_sql("'rule:' || f || ':' || name")} AS id, ({_RULE_SQL})[f] AS rule_type, condition, "action", 99 + row_number() OVER (ORDER BY ({_ORDER_SQL})[f], n) AS priority, confidence, src AS source_id, evidence_id FROM (
  SELECT f, n, name, {_CONDITION} AS condition, {_ACTION} AS "action", 0.9::DOUBLE AS confidence, src, evidence_id FROM l WHERE f IN ('{_TABLES[0]}', '{_TABLES[4]}', '{_TABLES[5]}')
  UNION ALL SELECT f, n, {_SLUG.format("title")}, json_object('section', title, 'source_file', f)::VARCHAR, json_object('policy', {_clean("quote")})::VARCHAR, 0.85::DOUBLE, src, own FROM s WHERE title <> '' AND f IN ('{_TEXTS[0]}', '{_TEXTS[2]}', '{_TEXTS[4]}'))"""


@query(f"WITH {_PACK} {_RULES}")
def compiled_rules(t):
    return C.rules(_links(t), _sections(t))


_GAPS = f"""SELECT 'gap-' || n AS id, 'publish_gap' AS kind, {_clean("summary")} AS description, CASE WHEN severity = '' THEN 'medium' ELSE severity END AS severity, status, src AS source_id, data AS details FROM r WHERE f = '{_TABLES[1]}'
UNION ALL SELECT 'gap-' || {_SLUG.format("CASE WHEN title = '' THEN 'payment-discount-policy' ELSE title END")}, 'commercial_gap_policy', {_clean("quote")}, 'medium', 'open', src, json_object('source_file', f)::VARCHAR FROM s WHERE f = '{_TEXTS[3]}'"""


@query(f"WITH {_PACK} {_GAPS}")
def compiled_gaps(t):
    return C.gaps(_rows(t), _sections(t))


_ROW_TEXT = "lower(concat_ws(' ', " + ", ".join([*_DATA, "status", "required_first_tool"]) + "))"
_TESTS = f"""SELECT 'test-' || {_SLUG.format("name")} AS id, name, {_clean("user_query")} AS prompt, '' AS expected_behavior, array_to_string(list_filter(list_transform(regexp_split_to_array(forbidden_behavior, '[;|,]'), lambda x: trim(x)), lambda x: x <> ''), '/') AS forbidden, evidence_id,
  regexp_matches({_ROW_TEXT}, '{"|".join(C.CRITICAL_ROW)}') AS critical, f AS filename FROM l WHERE f = '{_TABLES[2]}'
UNION ALL SELECT 'test-' || {_SLUG.format("f")} || '-' || {_SLUG.format("title")}, title, title, {_clean("quote")}, '', own, regexp_matches(lower(quote), '{"|".join(C.CRITICAL_TEXT)}'), f FROM s WHERE title <> '' AND f = '{_TEXTS[4]}'"""


@query(f"WITH {_PACK} {_TESTS}")
def compiled_tests(t):
    return C.tests(_links(t), _sections(t)).withColumn("forbidden", F.array_join("forbidden", "/"))


_TOOLS = f"""SELECT 'tool-' || {_SLUG.format("tool_name")} AS id, tool_name = 'handoff_to_human' AS needs_approval, tool_name, category, allowed, input_policy, output_policy, reason, confidence FROM (
  SELECT required_first_tool AS tool_name, 'tool_policy' AS category, array_to_string(regexp_split_to_array(min_by(allowed_followup_tools, n), ';'), '/') AS allowed, '' AS input_policy, min_by(expected_final_action, n) AS output_policy, 'Required for source-pack intent.' AS reason, 0.9::DOUBLE AS confidence FROM r
    WHERE f = '{_TABLES[5]}' AND required_first_tool <> '' GROUP BY 1
  UNION ALL SELECT x, 'runtime', '', 'Follow source-pack memory and tool policy.', 'Return grounded action or human handoff.', x || ' is part of the compounding pharmacy tool policy.', 0.85::DOUBLE FROM (SELECT unnest({_listed(C.TOOLS)}) AS x)
    WHERE x NOT IN (SELECT required_first_tool FROM r WHERE f = '{_TABLES[5]}'))"""


@query(f"WITH {_PACK} {_TOOLS}")
def compiled_tools(t):
    return C.tools(_rows(t)).withColumn("allowed", F.array_join("allowed", "/"))


@query(f"""WITH {_PACK}, m AS (SELECT string_agg(quote, chr(10) ORDER BY list_position({_listed(C.MEMORY_FILES)}, f), n) AS x FROM s WHERE f IN ('{_TEXTS[1]}', '{_TEXTS[2]}'))
SELECT {_clean(f"substr(x, 1, {C.NOTES})")} AS notes FROM m""")
def compiled_memory(t):
    return C.memory_notes(_sections(t))


_OPEN = f"SELECT count(*) FROM ({_GAPS}) WHERE status IN ('open', 'accepted')"


@query(f"WITH {_PACK} SELECT 'warning' AS status, greatest(0, 100 - 2 * n) AS score, '' AS blocking_reasons, n AS n_warnings FROM (SELECT ({_OPEN}) + {len(C.WARNINGS)} AS n)")
def compiled_readiness(t):
    links, sections = _links(t), _sections(t)
    evidence = links.select(F.col("own_id").alias("evidence_id")).union(C.evidence_sections(sections).select("evidence_id"))
    listed = C.sources(_rows(t).select("filename", "document_type").distinct())
    made = C.readiness(listed, C.facts(links), C.rules(links, sections), evidence, C.gaps(_rows(t), sections), C.tests(links, sections))
    return made.withColumn("blocking_reasons", F.array_join("blocking_reasons", "/"))


def _digest_sql(name, rows, line):
    sums = " || ':' || ".join(f"coalesce(sum(('0x' || h[{15 * k + 1}:{15 * k + 15}])::HUGEINT), 0)::VARCHAR" for k in range(4))
    return f"SELECT '{name}' AS section, count(*) AS n, sha256(count(*)::VARCHAR || ':' || {sums}) AS digest FROM (SELECT sha256({line}) AS h FROM ({rows}))"


@query(
    f"WITH {_PACK} "
    + _digest_sql("gaps", _GAPS, "json_object('description', description, 'details', details, 'id', id, 'kind', kind, 'severity', severity, 'source_id', source_id, 'status', status)::VARCHAR")
    + " UNION ALL "
    + _digest_sql("facts", _FACTS, "json_object('confidence', confidence, 'content', content, 'evidence_id', evidence_id, 'fact_type', fact_type, 'id', id, 'source_id', source_id)::VARCHAR")
)
def compiled_digests(t):
    return C.digests({"gaps": C.gaps(_rows(t), _sections(t)), "facts": C.facts(_links(t))})
