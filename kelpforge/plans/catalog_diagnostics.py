"""Queries over tables, checklists and figures of chunks and over counts: every document is a chunk to which lines were added."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as G
from ..operators import review
from .registry import query

_LINES = ["[x] Limpeza - Feito", "[ ] Peso", "ver Figura 3: Planta baixa", "a | b | c", "Anexo IV: sem legenda", "  [X]  Item: Ok - sim", "Limite   valor   unidade", "Imagem 2 - vide nota"]
_TEXT = "coalesce(text, '') || chr(10) || {} || chr(10) || chr(10) || {}"
_LISTED = "[" + ", ".join(f"'{x}'" for x in _LINES) + "]"
_FIGURE = G.FIGURE.replace("(?i)", "")
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_CHUNKS = rf"""
c AS (SELECT doc_id, {_TEXT.format(f"({_LISTED})[doc_id % 8 + 1]", f"({_LISTED})[doc_id // 8 % 8 + 1]")} AS text, CASE WHEN doc_id % 10 <> 0 THEN doc_id % 4 + 1 END AS page, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '1/1.2' END AS section_path FROM documents),
l AS (SELECT doc_id, sha256(text) || ':' || coalesce(page::VARCHAR, 'None') || ':' || CASE WHEN section_path = '' THEN 'unsectioned' ELSE section_path END || ':' AS at_, page, section_path,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS ls FROM c),
t AS (SELECT doc_id, at_, page, section_path, list_filter(ls, lambda x: length(x) - length(replace(x, '|', '')) >= 2 OR len(list_filter(regexp_split_to_array(x, '\s{{2,}}'), lambda y: y <> '')) >= 3) AS rows_ FROM l),
u AS (SELECT doc_id, at_, page, section_path, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM l),
found AS (SELECT doc_id, at_ || 'table:0' AS candidate_id, 'text_table' AS kind, array_to_string(rows_[1:5], chr(10)) AS quote, page AS page_number, section_path, 0.72::DOUBLE AS confidence, NULL AS label, NULL AS detail, len(rows_)::INT AS row_count FROM t WHERE len(rows_) > 0
  UNION ALL SELECT doc_id, at_ || 'checklist:' || k, 'checklist_row', line, page, section_path, 0.76, {_STRIP.format(f"regexp_extract(line, '{G.CHECKLIST}', 2)")},
    CASE WHEN trim(regexp_extract(line, '{G.CHECKLIST}', 3)) <> '' THEN lower(trim(regexp_extract(line, '{G.CHECKLIST}', 3))) WHEN lower(line) LIKE '[x]%' THEN 'checked' ELSE 'unchecked' END, NULL FROM u WHERE regexp_matches(line, '{G.CHECKLIST}')
  UNION ALL SELECT doc_id, at_ || 'figure:' || k, 'figure_reference', line, page, section_path, 0.74, {_STRIP.format(f"regexp_extract(line, '{_FIGURE}', 1, 'i')")}, {_STRIP.format(f"regexp_extract(line, '{_FIGURE}', 2, 'i')")}, NULL
    FROM u WHERE NOT regexp_matches(line, '{G.CHECKLIST}') AND regexp_matches(line, '{_FIGURE}', 'i'))"""


def _chunks(t):
    line = lambda k: F.get(F.array(*[F.lit(x) for x in _LINES]), k.cast("int"))
    key = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), line(key % 8), F.lit("\n\n"), line(F.floor(key / 8) % 8))
    return t("documents").select("doc_id", F.when(key % 10 != 0, key % 4 + 1).alias("page_start"), F.when(key % 3 == 0, "").otherwise("1/1.2").alias("section_path"), text.alias("text"), F.sha2(text, 256).alias("chunk_hash"))


@query(f"WITH {_CHUNKS} SELECT doc_id, candidate_id, kind, quote, page_number::INT AS page_number, section_path, confidence, label, detail, row_count FROM found")
def visual_candidates(t):
    return G.visual_candidates(_chunks(t))


_PROFILES = "SELECT doc_id, unnest([1, 2, 3, 4])::INT AS page_number, (doc_id % 3)::BIGINT AS image_count, n_chars AS text_chars, CASE WHEN doc_id % 5 = 0 THEN 'zeta,visual_content_without_caption' ELSE '' END AS risk_codes FROM documents"


@query(rf"""
WITH {_CHUNKS}, p AS ({_PROFILES}), told AS (SELECT DISTINCT doc_id, page_number FROM found WHERE kind = 'figure_reference' AND regexp_matches(detail, '[0-9A-Za-z]') AND NOT regexp_matches(lower(detail), '{"|".join(G.WEAK_CAPTIONS)}|^ver |^vide '))
SELECT doc_id, 'page:' || page_number || ':visual_risk' AS candidate_id, 'visual_risk' AS kind, 'page ' || page_number || ' contains visual content without extractable caption' AS quote, page_number, 0.6::DOUBLE AS confidence, image_count, text_chars,
  CASE WHEN risk_codes = '' THEN 'visual_content_without_caption' ELSE 'visual_content_without_caption,zeta' END AS risk_codes
FROM p ANTI JOIN told USING (doc_id, page_number) WHERE risk_codes <> '' OR (image_count > 0 AND text_chars < 200)""")
def visual_risks(t):
    page = F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])).alias("page_number")
    profiles = t("documents").select("doc_id", page, (F.col("doc_id") % 3).alias("image_count"), F.col("n_chars").alias("text_chars"), F.when(F.col("doc_id") % 5 == 0, "zeta,visual_content_without_caption").otherwise("").alias("risk_codes"))
    return G.visual_risks(profiles, G.visual_candidates(_chunks(t)))


_TALLIED = """SELECT doc_id, 'chunks' AS measure, NULL AS key FROM c UNION ALL SELECT doc_id, 'chunk_section', section_path FROM c WHERE section_path <> ''
  UNION ALL SELECT doc_id, 'visual_candidates', NULL FROM found UNION ALL SELECT doc_id, 'visual_kind', kind FROM found UNION ALL SELECT doc_id, 'visual_detail', detail FROM found WHERE detail <> ''"""


def _tallies(t):
    chunks = _chunks(t)
    return [G.tally(chunks, "chunks", {"chunk_section": F.col("section_path")}), G.tally(G.visual_candidates(chunks), "visual_candidates", {"visual_kind": F.col("kind"), "visual_detail": F.array("detail")})]


@query(f"WITH {_CHUNKS} SELECT doc_id, measure, key, count(*) AS n FROM ({_TALLIED}) GROUP BY ALL")
def document_diagnostics(t):
    return G.summed(_tallies(t), ["doc_id"])


@query(f"WITH {_CHUNKS} SELECT measure, key, count(*) AS n FROM ({_TALLIED}) GROUP BY ALL")
def corpus_diagnostics(t):
    return G.summed(_tallies(t))


@query("""
WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'gap' ELSE 'jump' END AS risk, CASE WHEN k = 2 AND doc_id % 3 = 0 THEN '1/1.1' ELSE '1' END AS section_path, (k + doc_id % 5)::INT AS page_number FROM (SELECT doc_id, unnest([1, 2]) AS k FROM documents)),
d AS (SELECT DISTINCT doc_id, risk FROM (SELECT doc_id, 'gap' AS risk FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, 'edge' FROM documents WHERE doc_id % 6 = 0)),
r AS (SELECT * FROM s WHERE risk <> '' UNION ALL SELECT doc_id, risk, NULL, NULL FROM d ANTI JOIN s USING (doc_id, risk))
SELECT doc_id || ':ambiguous_section_hierarchy:' || risk AS packet_id, doc_id, 'ambiguous_section_hierarchy' AS reason_code, 'medium' AS severity, 'inspect_section_hierarchy' AS suggested_decision, risk AS risk_code,
  CASE WHEN count(DISTINCT section_path) = 1 THEN min(section_path) END AS section_path, min(page_number) AS page_number, count(*) AS evidence_count FROM r GROUP BY doc_id, risk""")
def hierarchy_packets(t):
    key = F.col("doc_id")
    docs = t("documents").select("doc_id")
    spans = docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select(
        "doc_id", F.when(key % 4 == 0, "").when(key % 4 == 1, "gap").otherwise("jump").alias("risk"), F.when((F.col("k") == 2) & (key % 3 == 0), "1/1.1").otherwise("1").alias("section_path"), (F.col("k") + key % 5).cast("int").alias("page_number")
    )
    named = docs.where("doc_id % 2 = 1").withColumn("risk", F.lit("gap")).union(docs.where("doc_id % 6 = 0").withColumn("risk", F.lit("edge")))
    return review.section_packets(spans, named)
