"""Review packets: what a person has to look at, one row for each document, reason and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reason, severity, suggested decision.
REASONS = {
    "missing_metadata": ("high", "fill_missing_metadata"),
    "ambiguous_metadata": ("critical", "inspect_metadata_evidence"),
    "revision_family_conflict": ("critical", "choose_canonical_revision"),
    "ambiguous_section_hierarchy": ("medium", "inspect_section_hierarchy"),
    "low_confidence_semantic_unit": ("medium", "accept_edit_or_reject_candidate"),
    "visual_table_figure_risk": ("medium", "inspect_visual_evidence"),
}
LEAST_CONFIDENCE = 0.6


def _packets(rows: DataFrame, reason: Column, key: Column, risk: Column, path: Column | None = None, page: Column | None = None) -> DataFrame:
    """Rows grouped to packets: the number of rows as evidence, the one section path they share, the first page."""
    none = F.lit(None)
    keyed = rows.select("doc_id", reason.alias("reason_code"), key.cast("string").alias("key"), risk.alias("risk_code"), (path if path is not None else none).cast("string").alias("path"), (page if page is not None else none).cast("int").alias("page"))
    grouped = keyed.groupBy("doc_id", "reason_code", "key").agg(
        F.count("*").alias("evidence_count"), F.min("risk_code").alias("risk_code"), F.when(F.count_distinct("path") == 1, F.min("path")).alias("section_path"), F.min("page").alias("page_number")
    )
    severity, decision = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (level, suggestion) in REASONS.items():
        severity, decision = F.when(F.col("reason_code") == name, level).otherwise(severity), F.when(F.col("reason_code") == name, suggestion).otherwise(decision)
    packet_id = F.concat_ws(":", F.col("doc_id").cast("string"), "reason_code", "key")
    return grouped.select(packet_id.alias("packet_id"), "doc_id", "reason_code", severity.alias("severity"), decision.alias("suggested_decision"), "risk_code", "section_path", "page_number", "evidence_count")


def metadata_packets(gaps: DataFrame) -> DataFrame:
    """Of gaps ``doc_id, gap_code``: missing and ambiguous metadata."""
    code = F.col("gap_code")
    reason = F.when(code.startswith("missing_"), "missing_metadata").when(code.startswith("ambiguous_"), "ambiguous_metadata")
    return _packets(gaps.where(reason.isNotNull()), reason, code, code)


def section_packets(spans: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One packet a risk, of section spans that have one and of ``documents`` (``doc_id, risk``) whose diagnostics name one.

    A risk of a document that some span has, too, is told by those spans; else the packet rests on the risk alone.
    """
    risky = spans.where("risk <> ''").select("doc_id", "risk", "section_path", "page_number")
    if documents is not None:
        named = documents.select("doc_id", "risk").where("risk <> ''").distinct().join(risky.select("doc_id", "risk").distinct(), ["doc_id", "risk"], "left_anti")
        risky = risky.unionByName(named, allowMissingColumns=True)
    return _packets(risky, F.lit("ambiguous_section_hierarchy"), F.col("risk"), F.col("risk"), F.col("section_path"), F.col("page_number"))


def semantic_packets(found: DataFrame) -> DataFrame:
    """Of candidates ``doc_id, section, confidence``: those of low confidence, by section."""
    section = F.when(F.coalesce("section", F.lit("")) == "", "unsectioned").otherwise(F.col("section"))
    name = F.lit("low_confidence_semantic_unit")
    return _packets(found.where(F.col("confidence") < LEAST_CONFIDENCE), name, section, name, F.nullif(F.col("section"), F.lit("")))


def visual_packets(profiles: DataFrame) -> DataFrame:
    """Of page profiles: pages whose images stand without a caption."""
    risky = profiles.where(F.contains(F.col("risk_codes"), F.lit("visual_content_without_caption")))
    return _packets(risky, F.lit("visual_table_figure_risk"), F.col("page_number"), F.lit("visual_content_without_caption"), page=F.col("page_number"))


def revision_packets(families: DataFrame) -> DataFrame:
    """Of revision families ``doc_id, document_code, candidate_revision, blocking_gaps``: those in conflict."""
    name = F.lit("revision_family_conflict")
    key = F.concat_ws(":", F.coalesce("document_code", F.lit("unknown")), F.coalesce("candidate_revision", F.lit("unknown")))
    return _packets(families.where(F.contains(F.col("blocking_gaps"), F.lit("conflict"))), name, key, name)


def summary(packets: DataFrame) -> DataFrame:
    """Packets by reason and severity, with both totals."""
    return packets.groupingSets([["reason_code"], ["severity"], []], "reason_code", "severity").agg(F.count("*").alias("packets"))
