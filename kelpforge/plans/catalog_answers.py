"""Queries over questions and their answers, and over document metadata. Parts are read as facts and rules of five sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as A
from ..operators import metadata as M
from .registry import query

QUESTIONS = [
    (1, "qual o preco do cold widget"), (2, "horario large bolt"), (3, "aceita pix ou cartao"), (4, "aurora promocao"), (5, "zzzz"), (6, "volumoso"), (7, "quanto custa small ring e pix"), (8, "conflito steel"), (9, "de o a"),
]
MOST, BUDGET = 8, 60
KINDS = ["service_price", "business_hours", "payment_method", "faq_item"]
CONFLICTS = [(1, [21, 22, 23], ["s2", "s9"], "open"), (2, [40, 41], [], "needs_review"), (3, list(range(100)), ["s1"], "resolved")]


def _questions(t):
    return t("region").sparkSession.createDataFrame(QUESTIONS, "question_id long, question string")


def _records(t):
    key = F.col("p_partkey")
    extra = F.when(key % 13 == 4, " aurora").when(key % 97 == 5, " volumoso" + " longo" * 200).when(key.isin(21, 40), " conflito").otherwise("")
    status = F.when(key % 13 == 4, "needs_review").when(key % 29 == 7, "rejected").otherwise("published")
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (key % 4 + 1).cast("int"))
    text = F.concat("p_name", F.lit(" "), "p_type", extra)
    return t("part").select(
        key.alias("id"), F.when(key % 5 == 0, "rule").otherwise("fact").alias("record_class"), kind.alias("kind"), text.alias("text"), F.when(key % 4 == 0, F.col("p_name")).alias("entity"),
        ((key % 10) / 10).alias("confidence"), F.timestamp_seconds(F.lit(800_000_000) + key % 7 * 1000).alias("published_at"), F.concat(F.lit("s"), (key % 5).cast("string")).alias("source_id"), status.alias("status"),
        F.concat("p_name", F.lit(": "), "p_brand").alias("rendered"), X.text_tokens(text).alias("tokens"), F.concat(F.lit("e"), key.cast("string")).alias("evidence_id"), F.concat(F.lit("c"), (key % 9).cast("string")).alias("chunk_id"),
    )


def _terms(text):
    stop = ", ".join(f"'{x}'" for x in X.STOPWORDS)
    return f"list_distinct(list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9_]+'), lambda x: length(x) >= 3 AND x NOT IN ({stop})))"


_VOCABULARY = " UNION ALL ".join(f"SELECT '{kind}' AS kind, {words} AS vocabulary" for kind, words in X.INTENT_TERMS.items())
RANKED = f"""
v AS ({_VOCABULARY}), q AS (SELECT a AS question_id, {_terms('b')} AS asked FROM (VALUES {', '.join(f"({k}, '{s}')" for k, s in QUESTIONS)}) AS x(a, b)),
qq AS (SELECT *, list_filter(asked, lambda x: x NOT IN ({', '.join(f"'{x}'" for x in X.ALL_INTENT_TERMS)})) AS wanted FROM q),
r0 AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'rule' ELSE 'fact' END AS record_class, ({KINDS})[(p_partkey % 4 + 1)::INT] AS kind,
  p_name || ' ' || p_type || CASE WHEN p_partkey % 13 = 4 THEN ' aurora' WHEN p_partkey % 97 = 5 THEN ' volumoso' || repeat(' longo', 200) WHEN p_partkey IN (21, 40) THEN ' conflito' ELSE '' END AS text,
  CASE WHEN p_partkey % 4 = 0 THEN p_name END AS entity, (p_partkey % 10) / 10 AS confidence, p_partkey % 7 AS published, 's' || (p_partkey % 5) AS source_id,
  CASE WHEN p_partkey % 13 = 4 THEN 'needs_review' WHEN p_partkey % 29 = 7 THEN 'rejected' ELSE 'published' END AS status, p_name || ': ' || p_brand AS rendered FROM part),
r AS (SELECT *, {_terms('text')} AS own, list_filter({_terms("coalesce(entity, '')")}, lambda x: true) AS named, greatest(1, ceil(length(text) / 4))::BIGINT AS tokens FROM r0),
p0 AS (SELECT question_id, r.*, len(list_intersect(wanted, named)) AS entity_matches, (EXISTS (SELECT 1 FROM v WHERE v.kind = r.kind AND list_has_any(vocabulary, asked)))::INT AS intent, len(list_intersect(asked, own)) AS lexical,
  list_filter(named, lambda x: x NOT IN ({', '.join(f"'{x}'" for x in X.ALL_INTENT_TERMS)})) AS special, wanted FROM qq, r WHERE len(asked) > 0),
pairs AS (SELECT * FROM p0 WHERE (intent = 1 OR lexical > 0) AND NOT (len(special) > 0 AND len(wanted) > 0 AND NOT list_has_any(special, wanted))),
ranked AS (SELECT *, place + CASE WHEN record_class = 'rule' THEN {MOST} ELSE 0 END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id, record_class
  ORDER BY entity_matches DESC, intent DESC, lexical DESC, confidence DESC, published DESC, id) AS place FROM pairs WHERE status = 'published') WHERE place <= {MOST})"""


@query(f"WITH {RANKED} SELECT question_id, id, record_class, rank::INT AS rank, entity_matches::INT AS entity_matches, intent, lexical::INT AS lexical FROM ranked")
def ranked_context(t):
    return A.ranked_context(_questions(t), _records(t).where("status = 'published'"), MOST).select("question_id", "id", "record_class", "rank", "entity_matches", "intent", "lexical")


_CONFLICTS = ", ".join(f"({k}, {ids}::BIGINT[], {sources or '[]'}::VARCHAR[], '{status}')" for k, ids, sources, status in CONFLICTS)
OUTCOMES = f"""{RANKED}, n AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS k FROM ranked),
f AS (SELECT question_id, k, id, record_class, source_id, confidence, rendered, tokens <= {BUDGET} AS ok, CASE WHEN tokens <= {BUDGET} THEN tokens ELSE 0 END AS used FROM n WHERE k = 1
  UNION ALL SELECT n.question_id, n.k, n.id, n.record_class, n.source_id, n.confidence, n.rendered, f.used + n.tokens <= {BUDGET}, f.used + CASE WHEN f.used + n.tokens <= {BUDGET} THEN n.tokens ELSE 0 END FROM f JOIN n ON n.question_id = f.question_id AND n.k = f.k + 1),
c AS (SELECT question_id, list(DISTINCT cid ORDER BY cid) AS cids FROM ranked JOIN (VALUES {_CONFLICTS}) AS x(cid, ids, srcs, st) ON list_contains(ids, id) AND st IN ('open', 'needs_review') GROUP BY 1),
cs AS (SELECT question_id, list(s ORDER BY cid, pos) AS srcs FROM (SELECT question_id, cid, unnest(srcs) AS s, unnest(range(len(srcs))) AS pos FROM (SELECT question_id, unnest(cids) AS cid FROM c) JOIN (VALUES {_CONFLICTS}) AS x(cid2, ids, srcs, st) ON cid = cid2) GROUP BY 1),
w AS (SELECT DISTINCT question_id FROM pairs WHERE status = 'needs_review'),
g AS (SELECT question_id, count(*) AS candidates, count(*) FILTER (ok) AS fitting, max(used) AS used, max(confidence) FILTER (ok) AS confidence, string_agg(rendered, '; ' ORDER BY k) FILTER (ok AND record_class = 'fact') AS said,
  count(*) FILTER (ok AND record_class = 'rule') AS rules, string_agg(id::VARCHAR, ',' ORDER BY k) FILTER (ok AND record_class = 'fact') AS facts_used, string_agg(id::VARCHAR, ',' ORDER BY k) FILTER (ok AND record_class = 'rule') AS rules_used FROM f GROUP BY 1),
src AS (SELECT question_id, string_agg(source_id, ',' ORDER BY k) FILTER (ok) AS fit, string_agg(source_id, ',' ORDER BY k) AS every FROM
  (SELECT question_id, source_id, bool_or(ok) AS ok, coalesce(min(k) FILTER (ok), min(k)) AS k FROM f GROUP BY 1, 2) GROUP BY 1),
allsrc AS (SELECT question_id, string_agg(source_id, ',' ORDER BY k) AS every FROM (SELECT question_id, source_id, min(k) AS k FROM f GROUP BY 1, 2) GROUP BY 1),
st AS (SELECT qq.question_id, CASE WHEN c.cids IS NOT NULL THEN 'conflicting_sources' WHEN fitting > 0 THEN 'valid_answer' WHEN candidates > 0 THEN 'partial_answer' WHEN w.question_id IS NOT NULL THEN 'needs_human_validation' ELSE 'not_found' END AS answer_state,
  g.*, src.fit, allsrc.every, cs.srcs FROM qq LEFT JOIN g USING (question_id) LEFT JOIN c USING (question_id) LEFT JOIN cs USING (question_id) LEFT JOIN src USING (question_id) LEFT JOIN allsrc USING (question_id) LEFT JOIN w USING (question_id))"""


@query(f"""WITH RECURSIVE {OUTCOMES}
SELECT question_id, answer_state, CASE answer_state WHEN 'valid_answer' THEN '{A.FOUND}' || concat_ws(' ', said, CASE WHEN rules > 0 THEN rules || ' regra(s) publicada(s) relacionada(s).' END) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in A.STATES.items())} END AS answer,
  CASE WHEN answer_state = 'valid_answer' THEN coalesce(confidence, 0) ELSE 0 END::DOUBLE AS confidence, CASE WHEN answer_state = 'valid_answer' THEN coalesce(facts_used, '') ELSE '' END AS facts_used, CASE WHEN answer_state = 'valid_answer' THEN coalesce(rules_used, '') ELSE '' END AS rules_used,
  CASE answer_state WHEN 'valid_answer' THEN fit WHEN 'conflicting_sources' THEN coalesce(nullif(array_to_string(srcs, ','), ''), every) ELSE '' END AS sources_used,
  CASE answer_state WHEN 'partial_answer' THEN 'context_budget' WHEN 'needs_human_validation' THEN 'human_validation' WHEN 'not_found' THEN 'published_data' ELSE '' END AS missing_data,
  CASE WHEN answer_state = 'conflicting_sources' THEN 'conflict_requires_review' ELSE '' END AS warnings, CASE WHEN answer_state = 'valid_answer' THEN least({BUDGET}, used) ELSE 0 END::BIGINT AS tokens FROM st""")
def question_answers(t):
    conflicts = t("region").sparkSession.createDataFrame(CONFLICTS, "contradiction_id long, record_ids array<long>, source_ids array<string>, status string")
    unknowns = _records(t).where("id < 0")
    found = A.answers(_questions(t), _records(t), conflicts, unknowns, most=MOST, budget=BUDGET)
    return found.withColumns({c: F.array_join(c, ",") for c in ("facts_used", "rules_used", "sources_used")})


@query(f"""WITH {RANKED}
SELECT question_id, source_id, CASE WHEN source_id = 's0' THEN 'cost_list' ELSE 'File ' || source_id END AS source_name, 'e' || id AS evidence_id, CASE WHEN id % 2 = 0 AND id % 6 <> 0 THEN text[1:500] END AS quote,
  CASE WHEN id % 2 = 0 THEN (id % 40)::INT END AS page_number, CASE WHEN id % 2 = 0 AND id % 8 <> 0 THEN 'x' || id ELSE 'c' || (id % 9) END AS chunk_id, CASE WHEN record_class = 'fact' THEN id END AS fact_id, CASE WHEN record_class = 'rule' THEN id END AS rule_id
FROM ranked WHERE length(text) < 500""")
def answer_evidence(t):
    records, key = _records(t), F.col("p_partkey")
    even = t("part").where("p_partkey % 2 = 0")
    spans = even.select(
        F.concat(F.lit("e"), key.cast("string")).alias("evidence_id"), (key % 40).cast("int").alias("page_number"), F.when(key % 8 != 0, F.concat(F.lit("x"), key.cast("string"))).alias("chunk_id"), key.alias("id")
    ).join(records.select("id", F.when(F.col("id") % 6 == 0, F.concat(F.lit("margin "), "text")).otherwise(F.col("text")).alias("quote")), "id").drop("id")
    sources = records.select("source_id").distinct().select("source_id", F.when(F.col("source_id") == "s0", "cost_list").otherwise("").alias("filename"), F.concat(F.lit("File "), "source_id").alias("title"))
    used = A.ranked_context(_questions(t), records.where("status = 'published'"), MOST).where("length(text) < 500")
    return A.evidence(used, spans, sources)


@query("""
WITH d AS (SELECT p_partkey AS k, p_name AS n, (p_partkey % 1000)::VARCHAR AS c, (p_partkey % 30)::VARCHAR AS r FROM part)
SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN 'POP-QA-' || c WHEN 1 THEN 'IT LOG ' || c WHEN 2 THEN 'FOR-PR-' || c END AS document_code, CASE k % 4 WHEN 0 THEN 'POP' WHEN 1 THEN 'IT' WHEN 2 THEN 'Form' END AS document_type,
  CASE k % 4 WHEN 0 THEN n END AS title, CASE k % 4 WHEN 0 THEN lpad(r, 2, '0') WHEN 1 THEN r || '.2' WHEN 2 THEN lpad(r, 2, '0') END AS revision, CASE k % 4 WHEN 0 THEN 'vigent' WHEN 1 THEN 'draft' END AS status,
  CASE k % 4 WHEN 0 THEN 'Qualidade' END AS owner_area, CASE k % 4 WHEN 3 THEN 'missing_document_code,ambiguous_nested_document_codes,missing_revision' ELSE '' END AS gap_codes FROM d""")
def document_metadata(t):
    key, name = F.col("p_partkey"), F.col("p_name")
    code, number = (key % 1000).cast("string"), (key % 30).cast("string")
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("Código: pop-qa-"), code, F.lit("\nRevisão: "), number, F.lit("\nSituação: VIGENTE\nTítulo: "), name, F.lit("\nÁrea: Qualidade\n")))
        .when(key % 4 == 1, F.concat(F.lit("Documento\n\nIT LOG "), code, F.lit("\nVersão\n"), number, F.lit(".2\nRascunho\n"), name))
        .when(key % 4 == 2, name)
        .otherwise(F.concat(F.lit("Veja POP-QA-1 e IT-"), F.lit("LOG-"), code))
    )
    filename = F.when(key % 4 == 2, F.concat(F.lit("FOR-PR-"), code, F.lit(" rev"), number, F.lit(".txt"))).otherwise("file.txt")
    docs = t("part").select(key.alias("doc_id"), filename.alias("filename"), text.alias("text"))
    return M.metadata(docs).drop("filename", "text").withColumn("gap_codes", F.array_join("gap_codes", ","))
