"""The invariants over the outputs of all documents, with violations planted by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import invariants as I
from ..operators import review as V
from ..sources.stored import stored
from .catalog_documents import PAGES, PROFILES, TRIM, _profiles
from .registry import query


@query(rf"""
WITH {PROFILES},
chunks AS (SELECT doc_id FROM pages WHERE {TRIM.format('text')} <> ''),
cand AS (SELECT doc_id, page_number, {TRIM.format('line')} AS line FROM (SELECT doc_id, page_number, unnest(string_split(text, chr(10))) AS line FROM pages) WHERE {TRIM.format('line')} <> ''),
packets AS (SELECT doc_id, page_number FROM profiles WHERE contains(risk_codes, 'visual_content_without_caption')),
doubled AS (SELECT * FROM packets UNION ALL SELECT * FROM packets WHERE doc_id % 30 = 0)
SELECT 'quotes_in_source' AS invariant, count(*) AS checked, count(*) FILTER (doc_id % 50 = 0 OR doc_id % 70 = 0) AS violations FROM cand
UNION ALL SELECT 'pages_in_range', count(*), count(*) FILTER (doc_id % 70 = 0) FROM cand
UNION ALL SELECT 'chunk_spans', count(*), count(*) FILTER (doc_id % 40 = 0) FROM chunks
UNION ALL SELECT 'hashes_kept', count(*), count(*) FILTER (doc_id % 60 = 0) FROM chunks
UNION ALL SELECT 'texts_kept', count(*), count(*) FILTER (doc_id % 90 = 0 AND page_number = 1) FROM pages
UNION ALL SELECT 'known_risks', count(*), count(*) FILTER (page_number % 11 = 0) FROM profiles
UNION ALL SELECT 'packets_well_formed', count(*), count(*) FILTER (doc_id % 30 = 0) FROM doubled
UNION ALL SELECT 'packets_bounded', count(*), count(*) FILTER (doc_id % 30 = 0) FROM doubled""")
def invariant_report(t):
    paged = stored(D.pages(t("documents")), "pages")
    paged = paged.withColumn("page_number", F.coalesce("page_number", F.lit(0)))  # never null, which what was stored does not tell
    text = F.btrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    chunks = paged.select("doc_id", "page_number", F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), text.alias("text")).where("text <> ''")
    chunks = chunks.select("*", (F.length("text") + F.when(F.col("doc_id") % 40 == 0, 1).otherwise(0)).alias("char_count"), F.sha2("text", 256).alias("chunk_hash"))
    later = chunks.withColumn("chunk_hash", F.when(F.col("doc_id") % 60 == 0, "other").otherwise(F.col("chunk_hash")))
    far = F.when(F.col("doc_id") % 70 == 0, F.col("page_number") + 100_000).otherwise(F.col("page_number"))
    lines = D.lines(paged).select("doc_id", F.lit("step").alias("kind"), F.when(F.col("doc_id") % 50 == 0, F.concat("line", F.lit("\u0001"))).otherwise(F.col("line")).alias("quote"), far.alias("page_start"), far.alias("page_end"))
    profiles = stored(_profiles(t, paged), "profiles")
    coded = profiles.withColumn("risk_codes", F.when(F.col("page_number") % 11 == 0, F.concat("risk_codes", F.lit(",new_code"))).otherwise(F.col("risk_codes")))
    packets = stored(V.visual_packets(profiles), "packets")
    packets = packets.union(packets.where("doc_id % 30 = 0"))
    after = paged.withColumn("text", F.when((F.col("doc_id") % 90 == 0) & (F.col("page_number") == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    quoted, judged = I.quoted(lines, paged), I.judged_packets(packets)
    parts = [
        I.tally(quoted, quotes_in_source=F.col("unquoted"), pages_in_range=F.col("misplaced")),
        I.tally(chunks, chunk_spans=I.chunk_broken(chunks.columns)),
        I.tally(I.changed(chunks, later, ["doc_id", "page_number"], ["text", "chunk_hash"]), hashes_kept=F.col("changed")),
        I.tally(I.changed(paged, after, ["doc_id", "page_number"], ["text"]), texts_kept=F.col("changed")),
        I.tally(coded, known_risks=I.unknown_risk(F.col("risk_codes"))),
        I.tally(judged, packets_well_formed=F.col("malformed"), packets_bounded=F.col("repeated")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
