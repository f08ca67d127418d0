"""Source packs: rows and sections of listed files as facts, rules and evidence with stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..functions.values import stable_uuid

# Fixed values.
FACT_TABLES = ["catalog", "catalog_backlog", "normalization_catalog", "forms_catalog", "excipient_matrix", "supplier_catalog", "normalization_policy", "inventory_catalog", "price_catalog", "operations"]
RULE_TABLES = ["tool_policy", "quote_rules", "fulfillment_policy", "risk_matrix", "safety_matrix", "population_safety", "interaction_triggers", "regulatory_matrix", "mutation_contract"]
RULE_TEXTS = [
    "rules", "commercial_policy", "safety_policy", "clinical_boundary_policy", "labeling_policy", "stability_policy", "style_policy", "inventory_policy", "calendar_policy", "audit_policy",
    "refusal_examples", "sales_playbook", "objection_playbook", "quality_policy", "commercial_gap_policy",
]
SYNTHETIC = ["inventory_catalog", "price_catalog"]
MAX_QUOTE = 500
PRIVATE_PATH = r"(?i)(?:[A-Za-z]:\\(?:Users|Documents)|/(?:Users|home|root)/)[^\s,;)]*"
SECRET = r"(?i)sk-[A-Za-z0-9]{20,}|Bearer\s+[A-Za-z0-9._-]{20,}"


def safe_quote(text: Column) -> Column:
    """At most so many characters, private paths and secrets replaced; null if nothing is left."""
    cut = F.regexp_replace(F.regexp_replace(F.substring(text, 1, MAX_QUOTE), PRIVATE_PATH, "[REDACTED_PATH]"), SECRET, "[REDACTED_SECRET]")
    return F.nullif(trimmed(cut), F.lit(""))


def evidence_of_rows(rows: DataFrame) -> DataFrame:
    """Adds evidence_id, chunk_id and quote to table rows ``filename, row_number, cells``."""
    at = F.concat(F.col("filename"), F.lit(":row:"), F.col("row_number").cast("string"))
    filled = F.filter("cells", lambda x: x != "")
    return rows.withColumns({"evidence_id": stable_uuid(F.concat(F.lit("evidence:"), at)), "chunk_id": stable_uuid(F.concat(F.lit("chunk:"), at)), "quote": safe_quote(F.array_join(filled, " | "))})


def evidence_of_sections(sections: DataFrame) -> DataFrame:
    """Adds evidence_id, chunk_id and quote to Markdown sections ``filename, anchor, heading, body``."""
    at = F.concat_ws(":", "filename", "anchor")
    quote = safe_quote(F.concat(F.col("heading"), F.lit(": "), F.substring("body", 1, 400)))
    return sections.withColumns({"evidence_id": stable_uuid(F.concat(F.lit("evidence:"), at)), "chunk_id": stable_uuid(F.concat(F.lit("chunk:"), at)), "quote": quote})


def records_of_rows(rows: DataFrame) -> DataFrame:
    """Facts and rules from table rows by their file's ``document_type``; other types give none. A rule's priority is its row."""
    kind = F.when(F.col("document_type").isin(FACT_TABLES), "fact").when(F.col("document_type").isin(RULE_TABLES), "rule")
    marked = evidence_of_rows(rows).withColumn("record", kind).where("record IS NOT NULL")
    name = F.concat(F.col("record"), F.lit(":"), F.col("filename"), F.lit(":row:"), F.col("row_number").cast("string"))
    return marked.withColumns({"id": stable_uuid(name), "priority": F.when(F.col("record") == "rule", F.col("row_number")), "is_synthetic": F.col("document_type").isin(SYNTHETIC), "confidence": F.lit(1.0)})


def records_of_sections(sections: DataFrame) -> DataFrame:
    """Rules from sections of rule texts and facts from the others; bodies are cut to 800 characters."""
    kind = F.when(F.col("document_type").isin(RULE_TEXTS), "rule").otherwise("fact")
    marked = evidence_of_sections(sections).withColumn("record", kind)
    name = F.concat_ws(":", "record", "filename", "anchor")
    return marked.withColumns({"id": stable_uuid(name), "text": F.substring("body", 1, 800), "priority": F.when(F.col("record") == "rule", F.col("start_line")), "confidence": F.lit(1.0)})


def preflight(listed: DataFrame, present: DataFrame) -> DataFrame:
    """``filename, problem``: files listed but missing, and present but not listed."""
    missing = listed.select("filename").join(present.select("filename"), "filename", "left_anti").withColumn("problem", F.lit("missing"))
    extra = present.select("filename").join(listed.select("filename"), "filename", "left_anti").withColumn("problem", F.lit("unlisted"))
    return missing.unionByName(extra)


def counts(tables: dict[str, DataFrame], workspace: str) -> DataFrame:
    """Rows of a workspace in each table, for export, retention and deletion plans."""
    out = None
    for name, rows in tables.items():
        one = rows.where(F.col("workspace_id") == workspace).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
