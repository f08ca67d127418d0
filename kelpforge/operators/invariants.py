"""What must hold of all outputs, counted while they are written.

Every invariant is a column that is true of a row that breaks it. ``Watch`` hangs the counts on the outputs as observed metrics,
so that the job that writes them also judges them; rows that break one are only looked for where the count says that there are any.
Invariants that speak of two tables are joins whose rows are then judged like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as X
from .review import REASONS

# Fixed values.
RISK_CODES = [
    "ambiguous_nested_document_codes", "ambiguous_section_heading", "empty_page", "high_layout_complexity", "low_confidence_semantic_unit", "missing_document_code", "missing_revision", "ocr_required",
    "revision_family_conflict", "rotated_page", "section_hierarchy_gap", "sparse_text_with_images", "table_candidates_present", "visual_content_without_caption",
]
DOCUMENT_LEVEL = ["ambiguous_metadata", "missing_metadata", "revision_family_conflict"]
GENERATED = ["visual_risk"]


def _blank(text: Column) -> Column:
    return F.coalesce(X.trimmed(text), F.lit("")) == ""


def chunk_broken(columns: list[str]) -> Column:
    """A chunk without text, with a wrong length or hash, or with no, half, reversed or impossible places."""
    has = lambda name: F.col(name) if name in columns else F.lit(None).cast("int")
    first, last, page, row_a, row_b = (has(x) for x in ("page_start", "page_end", "source_page", "row_start", "row_end"))
    span = lambda a, b: (a.isNull() != b.isNull()) | F.coalesce((a <= 0) | (b <= 0) | (a > b), F.lit(False))
    outside = F.coalesce((page < first) | (page > last), F.lit(False)) | F.coalesce(first.isNull() & (page <= 0), F.lit(False))
    sheet = F.col("sheet_name") if "sheet_name" in columns else F.lit(None).cast("string")
    unnamed = (row_a.isNotNull() | row_b.isNotNull()) & _blank(sheet)
    nowhere = page.isNull() & first.isNull() & row_a.isNull()
    text = F.col("text")
    return _blank(text) | ~F.col("char_count").eqNullSafe(F.length(text)) | ~F.col("chunk_hash").eqNullSafe(F.sha2(text, 256)) | span(first, last) | outside | span(row_a, row_b) | unnamed | nowhere


def quoted(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """``candidates`` (``doc_id, kind, quote, page_start, page_end``) with ``unquoted`` and ``misplaced``.

    A quote must occur in its first page's text, without page in some page of the document; generated kinds quote nothing. Pages come
    in pairs, in order, within the document's. Candidates are numbered so that repeated ones stay apart.
    """
    own = candidates.withColumn("_n", F.monotonically_increasing_id())
    span = pages.groupBy("doc_id").agg(F.min("page_number").alias("_least"), F.max("page_number").alias("_most"))
    quote = X.trimmed(F.col("quote"))
    met = own.join(pages.select("doc_id", F.col("page_number").alias("page_start"), F.col("text").alias("_page")), ["doc_id", "page_start"], "left")
    placed = met.withColumn("_here", F.contains(F.col("_page"), quote)).drop("_page").join(span, "doc_id", "left")  # no page goes through a second shuffle
    anywhere = own.where("page_start IS NULL").join(pages.select("doc_id", F.col("text").alias("_any")), "doc_id").where(F.contains(F.col("_any"), quote)).select("_n").distinct().withColumn("_met", F.lit(True))
    joined = placed.join(anywhere, "_n", "left")
    held = F.coalesce(F.when(F.col("page_start").isNull(), F.col("_met")).otherwise(F.col("_here")), F.lit(False))
    first, last = F.col("page_start"), F.col("page_end")
    some = first.isNotNull() | last.isNotNull()
    within = F.coalesce((first <= last) & (first >= F.col("_least")) & (last <= F.col("_most")), F.lit(False))
    return joined.withColumns({"unquoted": ~F.col("kind").isin(GENERATED) & (_blank(F.col("quote")) | ~held), "misplaced": some & ~within}).drop("_n", "_here", "_least", "_most", "_met")


def changed(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys, changed``: rows that only one side has, or whose ``columns`` differ. Texts meet as their SHA-256."""
    mark = lambda rows, c: F.sha2(c, 256).alias(c) if rows.schema[c].dataType.typeName() == "string" else F.col(c)
    here = lambda rows, side: rows.select(*keys, F.struct(*[mark(rows, c) for c in columns]).alias(side))
    both = here(before, "_before").join(here(after, "_after"), keys, "full_outer")
    return both.select(*keys, (~F.col("_before").eqNullSafe(F.col("_after"))).alias("changed"))


def unknown_risk(codes: Column) -> Column:
    """Codes, joined by commas, among which some are not known."""
    return F.size(F.array_except(F.filter(F.split(F.coalesce(codes, F.lit("")), ","), lambda x: x != ""), F.array(*[F.lit(x) for x in RISK_CODES]))) > 0


def judged_packets(packets: DataFrame) -> DataFrame:
    """Review packets with ``malformed`` and ``repeated``: ids with blanks or used twice, unknown reasons, severities, decisions or
    risks, no evidence where some is due; and packets that say the same of a document as another."""
    ids = packets.groupBy("packet_id").agg(F.count("*").alias("_ids"))
    alike = ["doc_id", "reason_code", "risk_code", "section_path", "page_number"]
    equal = packets.groupBy(*alike).agg(F.count("*").alias("_alike"))
    both = packets.join(ids, "packet_id")
    matching = [both[c].eqNullSafe(equal[c]) for c in alike]
    condition = matching[0]
    for more in matching[1:]:
        condition = condition & more
    joined = both.join(equal, condition).select(*[both[c] for c in packets.columns], "_ids", "_alike")
    known = lambda name, values: F.coalesce(F.col(name).isin(list(values)), F.lit(False))
    bare = (F.coalesce("evidence_count", F.lit(0)) == 0) & (~known("reason_code", DOCUMENT_LEVEL) | _blank(F.col("risk_code")))
    wrong = _blank(F.col("packet_id")) | F.col("packet_id").rlike(r"\s") | (F.col("_ids") > 1) | ~known("reason_code", REASONS) | ~known("severity", {"critical", "high", "medium", "low"})
    wrong = wrong | ~known("suggested_decision", {d for _, d in REASONS.values()}) | bare | unknown_risk(F.col("risk_code"))
    return joined.withColumns({"malformed": wrong, "repeated": F.col("_alike") > 1}).drop("_ids", "_alike")


def tally(rows: DataFrame, **broken: Column) -> DataFrame:
    """``invariant, checked, violations`` of a table, one row an invariant."""
    counts = rows.agg(F.count("*").alias("checked"), *[F.count_if(v).alias(k) for k, v in broken.items()])
    each = F.array(*[F.struct(F.lit(k).alias("invariant"), F.col("checked"), F.col(k).alias("violations")) for k in broken])
    return counts.select(F.inline(each))


class Watch:
    """Counts violations of outputs as they are written, and shows some of those rows afterwards.

        watch = Watch()
        watch.over("chunks", chunks, spans=chunk_broken(chunks.columns)).write.parquet(path)
        watch.report()
    """

    def __init__(self, witnesses: int = 5):
        self.witnesses = witnesses
        self._watched: dict[str, tuple[Observation, DataFrame, dict[str, Column]]] = {}

    def over(self, name: str, rows: DataFrame, **broken: Column) -> DataFrame:
        """``rows`` as they are; the first job that runs them fills the counts."""
        seen = Observation(name)
        self._watched[name] = (seen, rows, broken)
        return rows.observe(seen, F.count("*").alias("checked"), *[F.count_if(v).alias(k) for k, v in broken.items()])

    def report(self) -> list[dict]:
        """One entry an invariant: ``output, invariant, checked, violations, witnesses``. Waits for outputs that are not written yet."""
        out = []
        for name, (seen, rows, broken) in self._watched.items():
            counts = seen.get
            for invariant, violated in broken.items():
                n = counts[invariant]
                shown = [r.asDict() for r in rows.where(violated).limit(self.witnesses).collect()] if n else []
                out.append({"output": name, "invariant": invariant, "checked": counts["checked"], "violations": n, "witnesses": shown})
        return out
