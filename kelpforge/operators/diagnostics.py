"""What chunks show of tables, checklists and figures, and how often each thing occurs in documents and in the corpus.

Counts are kept long: one row for each document, measure and key. A document's report and the corpus's are both sums of
those rows, so keys need not be known beforehand and no report is gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import documents as D

# Patterns of lines, how sure they are, and captions that say nothing.
CHECKLIST = r"^\s*\[([ xX])\]\s*(.+?)(?:\s*[-–:]\s*(.+))?\s*$"
FIGURE = r"(?i)\b(Figura\s+\d+|Imagem(?:\s+\d+)?|Fluxograma|Anexo(?:\s+(?:[IVXLCDM]+|\d+))?)\b\s*[-–:]?\s*(.*)$"
CONFIDENCE = {"text_table": 0.72, "checklist_row": 0.76, "figure_reference": 0.74, "visual_risk": 0.6}
WEAK_CAPTIONS = ["area reservada", "sem legenda", "imagem sem legenda", "placeholder", "apenas referencia"]
NO_CAPTIONS = ["ver ", "vide "]
PREVIEW_LINES, SPARSE_CHARS = 5, 200
NO_CAPTION_RISK = "visual_content_without_caption"


def checklist_status(mark: Column, status: Column) -> Column:
    """What the row says, in lower case, else whether it is ticked."""
    return F.when(status != "", F.lower(status)).otherwise(F.when(F.lower(F.trim(mark)) == "x", "checked").otherwise("unchecked"))


def strong_caption(caption: Column) -> Column:
    """Has a letter or digit, does not just refer to something else, and is no placeholder."""
    low = F.lower(F.trim(F.coalesce(caption, F.lit(""))))
    weak = [F.contains(low, F.lit(x)) for x in WEAK_CAPTIONS] + [low.startswith(x) for x in NO_CAPTIONS]
    said = low.rlike(r"[\p{L}\p{N}]")
    for one in weak:
        said = said & ~one
    return said


def visual_candidates(chunks: DataFrame) -> DataFrame:
    """Tables, checklist rows and figures of chunks ``doc_id, chunk_hash, page_start, section_path, text``.

    ``doc_id, candidate_id, kind, quote, page_number, section_path, confidence, label, detail, row_count``: ``detail`` is a row's status
    or a figure's caption. All table lines of a chunk are one candidate that quotes the first five. Every other kind is one line, and a
    checklist row is no figure. Lines are numbered among those that are not empty. Null texts have none.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r]"), X.trimmed), lambda x: x != "")
    held = chunks.withColumn("lines", lines)
    none = F.lit(None).cast("string")

    def of_line(line: Column, k: Column) -> Column:
        ticked = line.rlike(CHECKLIST)
        part = lambda pattern, n: X.trimmed(F.regexp_extract(line, pattern, n))
        row = _found("checklist_row", line, F.concat(F.lit("checklist:"), k.cast("string")), part(CHECKLIST, 2), checklist_status(F.regexp_extract(line, CHECKLIST, 1), part(CHECKLIST, 3)))
        figure = _found("figure_reference", line, F.concat(F.lit("figure:"), k.cast("string")), part(FIGURE, 1), part(FIGURE, 2))
        return F.when(ticked, row).when(line.rlike(FIGURE), figure)

    tabular = F.filter("lines", D.is_table_line)
    table = F.when(F.size(tabular) > 0, F.array(_found("text_table", F.array_join(F.slice(tabular, 1, PREVIEW_LINES), "\n"), F.lit("table:0"), none, none, F.size(tabular)))).otherwise(F.array())
    rows = held.select("doc_id", "chunk_hash", "page_start", "section_path", F.explode(F.concat(table, F.array_compact(F.transform("lines", of_line)))).alias("c"))
    section = F.coalesce(F.nullif("section_path", F.lit("")), F.lit("unsectioned"))
    page = F.coalesce(F.col("page_start").cast("string"), F.lit("None"))
    return rows.select("doc_id", F.concat_ws(":", "chunk_hash", page, section, "c.suffix").alias("candidate_id"), "c.kind", "c.quote", F.col("page_start").cast("int").alias("page_number"), "section_path", "c.confidence", "c.label", "c.detail", "c.row_count")


def _found(kind: str, quote: Column, suffix: Column, label: Column, detail: Column, rows: Column | None = None) -> Column:
    count = (F.lit(None) if rows is None else rows).cast("int")
    return F.struct(F.lit(kind).alias("kind"), quote.alias("quote"), suffix.alias("suffix"), F.lit(CONFIDENCE[kind]).alias("confidence"), label.alias("label"), detail.alias("detail"), count.alias("row_count"))


def visual_risks(profiles: DataFrame, found: DataFrame) -> DataFrame:
    """Of page profiles (``doc_id, page_number, image_count, text_chars, risk_codes``) those whose images nothing explains.

    A page on which some figure has a strong caption is none. ``risk_codes`` is sorted, joined by commas, and names the missing caption.
    """
    told = found.where((F.col("kind") == "figure_reference") & strong_caption(F.col("detail"))).select("doc_id", "page_number").distinct()
    codes = F.filter(F.split(F.coalesce("risk_codes", F.lit("")), ","), lambda x: x != "")
    bare = F.array_contains(codes, NO_CAPTION_RISK) | ((F.col("image_count") > 0) & (F.col("text_chars") < SPARSE_CHARS))
    page = F.col("page_number").cast("string")
    return profiles.join(told, ["doc_id", "page_number"], "left_anti").where(F.col("page_number").isNotNull() & bare).select(
        "doc_id", F.concat(F.lit("page:"), page, F.lit(":visual_risk")).alias("candidate_id"), F.lit("visual_risk").alias("kind"), F.concat(F.lit("page "), page, F.lit(" contains visual content without extractable caption")).alias("quote"),
        F.col("page_number").cast("int").alias("page_number"), F.lit(CONFIDENCE["visual_risk"]).alias("confidence"), "image_count", "text_chars", F.array_join(F.array_sort(F.array_union(codes, F.array(F.lit(NO_CAPTION_RISK)))), ",").alias("risk_codes"),
    )


def tally(rows: DataFrame, total: str, counted: dict[str, Column]) -> DataFrame:
    """``doc_id, measure, key, n``: rows of each document under ``total`` (no key), and for each measure how many have which key.

    A measure is a text or an array of texts; nulls and empty texts are not counted. A row gives a few small rows which each task sums
    before they are shuffled.
    """

    def named(name):
        return lambda x: one(name, x)

    one = lambda name, key: F.struct(F.lit(name).alias("measure"), key.cast("string").alias("key"))
    marks = F.array(one(total, F.lit(None)))
    for name, key in counted.items():
        keys = key if rows.select(key).schema[0].dataType.typeName() == "array" else F.array(key)
        said = F.filter(keys, lambda x: F.coalesce(x, F.lit("")) != "")
        marks = F.concat(marks, F.coalesce(F.transform(said, named(name)), F.array().cast("array<struct<measure:string,key:string>>")))
    return rows.select("doc_id", F.explode(marks).alias("m")).groupBy("doc_id", "m.measure", "m.key").agg(F.count("*").alias("n"))


def summed(tallies: list[DataFrame], by: list[str] | None = None) -> DataFrame:
    """The corpus's counts, or those of groups ``by``, of several tallies."""
    out = tallies[0]
    for one in tallies[1:]:
        out = out.unionByName(one)
    return out.groupBy(*(by or []), "measure", "key").agg(F.sum("n").alias("n"))


def expected_documents(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Of file names that were expected whether they are there: ``file_name, present``, each once."""
    there = present.select("file_name").distinct().withColumn("present", F.lit(True))
    return expected.select("file_name").distinct().join(there, "file_name", "left").fillna(False, ["present"])
