"""Queries over a store whose tables change together: every document is ingested, a third of them again, half of them classified."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import documents as D
from ..sources.committed import Change, Store, complete_classification, complete_extraction, complete_ingest, shared_folder
from ..sources.stored import stored
from .registry import query

SMALL, SMALL_STEP = 1600, 1400


def _filled(t) -> Store:
    """A store after five changes and one that was never published."""
    docs = t("documents").select("doc_id", "text")
    store = Store(docs.sparkSession, f"{shared_folder(docs.sparkSession)}/store-{uuid.uuid4().hex}")
    reports = stored(D.quality_gate(D.pages(docs)).select(F.col("doc_id").alias("source_id"), "passed", "rejection_reason", "warnings"), "reports")
    job = lambda letter, rows: rows.select(F.concat(F.lit(letter), F.col("doc_id").cast("string")).alias("job_key"), F.col("doc_id").alias("source_id"))

    def cut(rows, size, step):
        return D.windows(rows, size, step).select(F.col("doc_id").alias("source_id"), F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", "chunk_hash", "token_estimate")

    complete_ingest(store, job("i", docs), reports, cut(docs, D.WINDOW_CHARS, D.WINDOW_STEP))
    again = docs.where("doc_id % 3 = 0")
    complete_ingest(store, job("r", again).union(job("i", docs)), reports, cut(again, SMALL, SMALL_STEP))
    complete_ingest(store, job("r", again), reports.limit(0), cut(docs, 9, 9).limit(0))  # all of these jobs are complete
    fifth = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("source_id"))
    store.stage(Change(job("x", docs).limit(0)).replace("chunks", fifth, "source_id", store.read("chunks").limit(0)))  # its writer is lost
    chunks = stored(store.read("chunks").where("source_id % 2 = 0"), "chunks")
    key = lambda letter: F.concat(F.lit(letter), F.col("chunk_id"))
    jobs = chunks.select(key("c").alias("job_key"), "source_id", "chunk_id")
    long = F.col("token_estimate") > 300
    decisions = chunks.select("chunk_id", F.when(long, "classified").otherwise("unknown").alias("status"), F.when(long, "prose").alias("classification"))
    unknown = chunks.where(~long).select("chunk_id", F.col("chunk_hash").alias("raw_text"), F.lit("faq_item").alias("suggested_type"), F.lit(0.4).alias("confidence"))
    complete_classification(store, jobs, decisions, unknown, chunks.where(long).select("chunk_id", key("e").alias("job_key")))
    ready = stored(store.read("jobs").where("kind = 'extraction' AND source_id % 4 = 0").select("job_key", "source_id", F.substring("job_key", 2, 1000).alias("chunk_id")), "ready")
    each = ready.select("job_key", F.explode(F.array(F.lit("fact"), F.lit("rule"))).alias("kind"), F.lit("prose").alias("type"), F.lit("{}").alias("payload"), F.lit(0.9).alias("confidence"))
    spans = ready.select("job_key", F.col("chunk_id").alias("quote"), F.lit(0).alias("char_start"), F.lit(1).alias("char_end"))
    complete_extraction(store, ready, ready.select("job_key", F.lit("extracted").alias("status")), spans, each, ready.limit(0).select("job_key", F.lit("").alias("raw_text")))
    return store


_CUT = """SELECT doc_id AS source_id, i AS chunk_index, substr(text, i * step + 1, size) AS chunk FROM (SELECT doc_id, text, size, step,
  unnest(range(0, CASE WHEN length(text) <= size THEN 1 ELSE ceil((length(text) - size) / step::DOUBLE)::BIGINT + 1 END)) AS i FROM
  (SELECT doc_id, text, {size} AS size, {step} AS step FROM documents WHERE length(text) > 0 AND {when}))"""
WIDE = _CUT.format(size=D.WINDOW_CHARS, step=D.WINDOW_STEP, when="doc_id % 3 <> 0")
NARROW = _CUT.format(size=SMALL, step=SMALL_STEP, when="doc_id % 3 = 0")
CURRENT = f"cur AS (SELECT *, length(chunk) // 4 AS tokens FROM ({WIDE} UNION ALL {NARROW}))"


@query(f"""
WITH {CURRENT} SELECT source_id, chunk_index::INT AS chunk_index, sha256(chunk) AS chunk_hash,
  CASE WHEN source_id % 2 = 1 THEN 'pending' WHEN tokens <= 300 THEN 'unknown' WHEN source_id % 4 = 0 THEN 'extracted' ELSE 'classified' END AS status,
  CASE WHEN source_id % 2 = 0 AND tokens > 300 THEN 'prose' END AS classification FROM cur""")
def committed_chunks(t):
    store = _filled(t)
    states = store.read("chunk_states").select("chunk_id", F.col("status").alias("now"), "classification")
    return store.read("chunks").join(states, "chunk_id", "left").select("source_id", "chunk_index", "chunk_hash", F.coalesce("now", "status").alias("status"), "classification")


_ALL = _CUT.format(size=D.WINDOW_CHARS, step=D.WINDOW_STEP, when="true")


@query(f"""
WITH {CURRENT}, first AS (SELECT source_id, count(*) AS n FROM ({_ALL}) GROUP BY 1), now_ AS (SELECT source_id, count(*) AS n FROM cur GROUP BY 1),
c AS (SELECT source_id, source_id || ':' || chunk_index AS chunk_id, tokens FROM cur WHERE source_id % 2 = 0)
SELECT 'i' || doc_id AS job_key, doc_id AS source_id, 'ingest' AS kind, 'succeeded' AS status, coalesce(n, 0) AS records FROM documents LEFT JOIN first ON source_id = doc_id
UNION ALL SELECT 'r' || doc_id, doc_id, 'ingest', 'succeeded', coalesce(n, 0) FROM documents LEFT JOIN now_ ON source_id = doc_id WHERE doc_id % 3 = 0
UNION ALL SELECT 'c' || chunk_id, source_id, 'classification', 'succeeded', (tokens > 300)::BIGINT FROM c
UNION ALL SELECT 'e' || chunk_id, source_id, 'extraction', CASE WHEN source_id % 4 = 0 THEN 'succeeded' ELSE 'queued' END, CASE WHEN source_id % 4 = 0 THEN 2 ELSE 0 END FROM c WHERE tokens > 300""")
def committed_jobs(t):
    return _filled(t).read("jobs").select("job_key", "source_id", "kind", "status", "records")
