"""A source pack compiled as one plan: rows and sections of files of different shapes as facts, rules, gaps, tests, tools and policy.

Rows are ``filename, row_number, document_type, data`` (a map of texts), sections are ``filename, start_line, heading, body``. What a
record rests on is found by its anchor, else it is the first evidence of its file. Files may be of any size and one may hold most rows:
numbers that run through all files come from counts of blocks of rows, and equality joins meet one row a key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import stable_uuid
from . import packs

# What the files of a pack are for, the keys of their rows, and the texts of a policy.
RULE_FILES = {
    "04_allergens_excipients_triage.csv": "allergen_handoff", "05_sales_triage_rules.md": "sales_triage", "10_quote_pricing_policy.md": "quote_pricing", "16_memory_and_tool_policy.md": "memory_tool_policy",
    "21_controlled_antimicrobial_handoff_matrix.csv": "safety_handoff", "28_inventory_freshness_policy.md": "inventory_freshness", "31_calendar_event_policy.md": "calendar_event", "40_quote_rules_matrix.csv": "quote_rule",
    "53_tool_calling_policy_matrix.csv": "tool_policy", "55_audit_and_rollback_policy.md": "audit_rollback", "63_release_gate_eval_suite.md": "release_gate",
}
TEST_FILES = [
    "06_context_builder_expected_tests.md", "17_sample_user_queries.csv", "47_adverse_event_scenarios.csv", "49_clinical_boundary_eval_cases.csv", "54_tool_calling_expected_traces.csv", "58_long_conversation_scenarios.csv",
    "59_synthetic_customer_query_eval_set.csv", "63_release_gate_eval_suite.md", "64_failure_modes_and_regression_tests.md",
]
GAP_ROWS, GAP_TEXT, TOOL_ROWS = "14_known_gaps_and_publish_gates.csv", "43_payment_discount_gap_policy.md", "53_tool_calling_policy_matrix.csv"
MEMORY_FILES = ["16_memory_and_tool_policy.md", "13_prescription_document_handling.md", "24_patient_friendly_safe_language.md"]
FACT_TYPES = {"02_active_ingredients_catalog.csv": "active_ingredient", "04_allergens_excipients_triage.csv": "allergen_excipient"}
FACT_WORDS = ["inventory", "price", "calendar"]
ID_KEYS = ["item_id", "rule_id", "gap_id", "test_id", "case_id", "query_id", "policy_id", "trace_id", "scenario_id", "stock_id", "price_id"]
CONDITION_KEYS = ["trigger", "user_intent_class", "item_or_class", "blocking_conditions"]
ACTION_KEYS = ["next_action", "expected_final_action", "allowed_quote_status", "expected_action"]
PROMPT_KEYS = ["user_query", "query", "scenario", "input"]
EXPECTED_KEYS = ["expected_behavior", "expected_action", "expected_output_class", "required_refusal_phrase"]
CRITICAL_ROW = ["critical", "high", "adverse", "boundary", "controlled", "allergy"]
CRITICAL_TEXT = ["critical", "must", "blocked", "forbidden", "regression", "failure"]
TOOLS = ["search_knowledge", "query_graph", "check_inventory", "create_quote", "schedule_event", "handoff_to_human", "create_ticket"]
APPROVED_TOOL = "handoff_to_human"
WARNINGS = ["Synthetic inventory only", "Official full DCB list not materialized", "ERP not integrated", "Prices are synthetic"]
FIRST_PRIORITY, NOTES = 100, 1200
BLOCK = 4096


@dataclass(frozen=True)
class Roles:
    """Which file of a pack is for what; rules are numbered in the order of ``rules``."""

    rules: dict[str, str] = field(default_factory=lambda: dict(RULE_FILES))
    tests: list[str] = field(default_factory=lambda: list(TEST_FILES))
    gap_rows: str = GAP_ROWS
    gap_text: str = GAP_TEXT
    tools: str = TOOL_ROWS
    memory: list[str] = field(default_factory=lambda: list(MEMORY_FILES))


def rows_of_tables(tables: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of ``path, row_index, headers, cells`` with their file's ``document_type`` of ``listed`` (``csv`` if not there).

    Of equal headers the last one counts, missing cells are empty.
    """
    later = lambda k: F.slice("headers", k + 2, F.size("headers"))
    cell = lambda h, k: F.struct(h.alias("key"), F.coalesce(F.get("cells", k), F.lit("")).alias("value"), F.array_contains(later(k), h).alias("again"))
    kept = F.filter(F.transform("headers", cell), lambda x: ~x["again"])
    data = F.map_from_entries(F.transform(kept, lambda x: F.struct(x["key"], x["value"])))
    named = tables.where("headers IS NOT NULL").select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("row_index").alias("row_number"), data.alias("data"))
    return named.join(listed.select("filename", "document_type"), "filename", "left").fillna("csv", ["document_type"])


def problems(texts: DataFrame) -> DataFrame:
    """``filename, problem`` of files ``filename, text`` that may not be compiled: empty ones, and each forbidden mark or pattern."""
    found = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.array(F.lit("empty"))).otherwise(T.forbidden(F.col("text")))
    return texts.select("filename", F.explode(found).alias("problem"))


def sources(listed: DataFrame) -> DataFrame:
    """One published source for each file ``filename, document_type``."""
    stem = F.regexp_replace(F.substring("filename", 4, 1 << 20), r"\.[^.]*$", "")
    kind = F.when(F.lower("filename").endswith(".md"), "markdown").otherwise("csv")
    return listed.select(
        source_id("filename").alias("id"), F.initcap(F.replace(stem, F.lit("_"), F.lit(" "))).alias("title"), "filename", kind.alias("type"), F.lit("synthetic_approved").alias("source_reliability"),
        F.col("document_type").alias("authority_level"), F.lit("published").alias("status"),
    )


def source_id(filename: str) -> Column:
    return stable_uuid(F.concat(F.lit("source:"), F.col(filename)))


def _first(keys: list[str], otherwise: Column | str = "") -> Column:
    """The first of these keys that has a value in ``data``."""
    values = [F.nullif(F.try_element_at("data", F.lit(k)), F.lit("")) for k in keys]
    return F.coalesce(*values, F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def _cleaned() -> Column:
    return F.transform_values("data", lambda _, v: T.redacted(F.coalesce(v, F.lit(""))))


def _chosen(keys: list[str], otherwise: str) -> Column:
    """JSON of those keys that have a value in the column ``cleaned``, or of all of it under ``otherwise`` if none has."""
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.try_element_at("cleaned", F.lit(k)).alias("value")) for k in keys]), lambda x: x["value"] != "")
    return F.when(F.size(pairs) > 0, F.to_json(F.map_from_entries(pairs))).otherwise(F.to_json(F.struct(F.col("cleaned").alias(otherwise))))


def record_name() -> Column:
    return _first(ID_KEYS, F.concat(F.lit("row-"), F.col("row_number").cast("string")))


def quoted_heading(quote: Column) -> Column:
    """The first line of a quote that begins with ``#``, without those; empty if there is none.

    A section's quote begins with its heading's bare text, so only marked lines of its body count.
    """
    return T.trimmed(F.regexp_extract(F.coalesce(quote, F.lit("")), r"(?:^|\n)#++([^\n]*)", 1))


def quoted_anchors(quote: Column) -> Column:
    """What stands in backticks in the items of a quote's list of evidence anchors."""

    def step(acc, line):
        line = T.trimmed(line)
        mark = line.startswith("#")
        name = F.regexp_extract(line, "^- `([^`]*)`", 1)
        inside = F.when(mark, F.contains(line, F.lit("Evidence Anchors"))).otherwise(acc["inside"])
        found = F.when(~mark & acc["inside"] & (name != ""), F.concat(acc["found"], F.array(name))).otherwise(acc["found"])
        return F.struct(inside.alias("inside"), found.alias("found"))

    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(F.split(F.coalesce(quote, F.lit("")), "\n"), start, step, lambda acc: acc["found"])


def evidence_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with ``evidence_id, chunk_id, quote`` and the ``anchor`` they name (null if none)."""
    cells = F.transform(F.map_values("data"), lambda x: F.coalesce(x, F.lit("")))
    made = packs.evidence_of_rows(rows.withColumn("cells", cells)).drop("cells")
    return made.withColumn("anchor", F.nullif(_first(["evidence_anchor", "anchor"]), F.lit("")))


def evidence_sections(sections: DataFrame) -> DataFrame:
    """``sections`` with ``anchor, evidence_id, chunk_id, quote``."""
    return packs.evidence_of_sections(sections.withColumn("anchor", T.slug(F.col("heading"))))


def linked(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """``rows`` with the evidence they rest on as ``evidence_id``, their own as ``own_id``.

    An anchor stands for the last row that names it or, if no row does, for the first section that lists it. A row without an anchor
    rests on the first evidence of its file. Both look-ups meet one row a key; rows without an anchor are dealt by their own id.
    """
    made = evidence_rows(rows)
    text = evidence_sections(sections)
    at = lambda place: F.struct("filename", F.col(place).cast("long").alias("place"))
    none = F.lit(None).cast("struct<filename:string,place:bigint>")
    of_rows = made.where("anchor IS NOT NULL").select("anchor", "evidence_id", at("row_number").alias("in_rows"), none.alias("in_text"))
    of_text = text.select(F.explode(quoted_anchors(F.col("quote"))).alias("anchor"), "evidence_id", none.alias("in_rows"), at("start_line").alias("in_text"))
    anchors = of_rows.unionByName(of_text).groupBy("anchor").agg(F.coalesce(F.max_by("evidence_id", "in_rows"), F.min_by("evidence_id", "in_text")).alias("by_anchor"))
    files = made.groupBy("filename").agg(F.min_by("evidence_id", "row_number").alias("by_file"))
    dealt = made.withColumn("key", F.coalesce("anchor", "evidence_id")).join(anchors.withColumnRenamed("anchor", "key"), "key", "left").drop("key")
    return dealt.join(files, "filename", "left").withColumn("own_id", F.col("evidence_id")).withColumn("evidence_id", F.coalesce(F.when(F.col("anchor").isNotNull(), F.col("by_anchor")), "by_file")).drop("by_anchor", "by_file")


def facts(links: DataFrame, roles: Roles | None = None) -> DataFrame:
    """``id, fact_type, content, confidence, source_id, evidence_id`` of linked rows that are no gaps, tests or tools."""
    roles = roles or Roles()
    kept = links.where(~F.col("filename").isin(roles.tests + [roles.gap_rows, roles.gap_text, roles.tools]))
    kind = F.element_at(T.named(FACT_TYPES), F.col("filename"))
    for word in FACT_WORDS:
        kind = F.coalesce(kind, F.when(F.contains("filename", F.lit(word)), word))
    content = F.to_json(F.struct(F.col("filename").alias("source_file"), record_name().alias("record_id"), "document_type", _cleaned().alias("data")))
    name = F.concat_ws(":", F.lit("fact"), "filename", F.col("row_number").cast("string"), record_name())
    return kept.select(
        stable_uuid(name).alias("id"), F.coalesce(kind, F.replace("document_type", F.lit("-"), F.lit("_"))).alias("fact_type"), content.alias("content"), F.lit(0.9).alias("confidence"), source_id("filename").alias("source_id"), "evidence_id"
    )


def numbered(rows: DataFrame, files: list[str], first: int) -> DataFrame:
    """``rows`` (``filename, place``) with ``priority``, running from ``first`` through the files in their order, then by place.

    Blocks of rows are counted, counts summed up within and over files, and rows numbered within their block, so that no task
    holds a file. Equal places count in no order.
    """
    order = F.element_at(T.named({f: f"{k:06d}" for k, f in enumerate(files)}), F.col("filename"))
    dealt = rows.withColumns({"file_order": order, "block": F.floor(F.col("place") / BLOCK)})
    counts = dealt.groupBy("file_order", "block").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("file_order").agg(F.sum("n").alias("n"))
    in_file = counts.select("file_order", "block", F.coalesce(F.sum("n").over(Window.partitionBy("file_order").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("in_file"))
    of_files = sizes.select("file_order", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("file_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("of_files"))
    at = F.row_number().over(Window.partitionBy("file_order", "block").orderBy("place"))
    placed = dealt.withColumn("at", at).join(in_file, ["file_order", "block"]).join(F.broadcast(of_files), "file_order")  # one row for each named file
    return placed.withColumn("priority", F.col("of_files") + F.col("in_file") + F.col("at") + (first - 1)).drop("file_order", "block", "at", "in_file", "of_files")


def rules(links: DataFrame, sections: DataFrame, roles: Roles | None = None) -> DataFrame:
    """``id, rule_type, condition, action, priority, confidence, source_id, evidence_id``, numbered through all rule files."""
    roles = roles or Roles()
    files = list(roles.rules)
    of_rows = links.where(F.col("filename").isin(files)).withColumn("cleaned", _cleaned()).select(
        "filename", F.col("row_number").cast("long").alias("place"), record_name().alias("name"), _chosen(CONDITION_KEYS, "match").alias("condition"), _chosen(ACTION_KEYS, "apply").alias("action"), F.lit(0.9).alias("confidence"), "evidence_id"
    )
    text = evidence_sections(sections.where(F.col("filename").isin(files))).withColumn("title", quoted_heading(F.col("quote"))).where("title <> ''")
    condition = F.to_json(F.struct(F.col("title").alias("section"), F.col("filename").alias("source_file")))
    action = F.to_json(F.struct(T.redacted(F.col("quote")).alias("policy")))
    of_text = text.select("filename", F.col("start_line").cast("long").alias("place"), T.slug(F.col("title")).alias("name"), condition.alias("condition"), action.alias("action"), F.lit(0.85).alias("confidence"), "evidence_id")
    made = numbered(of_rows.unionByName(of_text), files, FIRST_PRIORITY)
    kind = F.element_at(T.named(roles.rules), F.col("filename"))
    return made.select(stable_uuid(F.concat_ws(":", F.lit("rule"), "filename", "name")).alias("id"), kind.alias("rule_type"), "condition", "action", "priority", "confidence", source_id("filename").alias("source_id"), "evidence_id")


def gaps(rows: DataFrame, sections: DataFrame, roles: Roles | None = None) -> DataFrame:
    """``id, kind, description, severity, status, source_id, details`` of listed gaps and of the sections of a gap policy."""
    roles = roles or Roles()
    of_rows = rows.where(F.col("filename") == roles.gap_rows).select(
        _first(["gap_id"], F.concat(F.lit("gap-"), F.col("row_number").cast("string"))).alias("id"), F.lit("publish_gap").alias("kind"), T.redacted(_first(["summary"])).alias("description"), _first(["severity"], "medium").alias("severity"),
        _first(["status"], "open").alias("status"), source_id("filename").alias("source_id"), F.to_json(_cleaned()).alias("details"),
    )
    text = evidence_sections(sections.where(F.col("filename") == roles.gap_text))
    title = F.coalesce(F.nullif(quoted_heading(F.col("quote")), F.lit("")), F.lit("payment-discount-policy"))
    of_text = text.select(
        F.concat(F.lit("gap-"), T.slug(title)).alias("id"), F.lit("commercial_gap_policy").alias("kind"), T.redacted(F.coalesce("quote", F.lit(""))).alias("description"), F.lit("medium").alias("severity"), F.lit("open").alias("status"),
        source_id("filename").alias("source_id"), F.to_json(F.struct(F.col("filename").alias("source_file"))).alias("details"),
    )
    return of_rows.unionByName(of_text)


def tests(links: DataFrame, sections: DataFrame, roles: Roles | None = None) -> DataFrame:
    """``id, name, prompt, expected_behavior, forbidden, evidence_id, critical, filename`` of test rows and of headed test sections."""
    roles = roles or Roles()
    critical = F.lower(F.array_join(F.map_values("data"), " ")).rlike("|".join(CRITICAL_ROW))
    forbidden = F.transform(T.split_values(_first(["forbidden_behavior"])), T.redacted)
    of_rows = links.where(F.col("filename").isin(roles.tests)).select(
        F.concat(F.lit("test-"), T.slug(record_name())).alias("id"), record_name().alias("name"), T.redacted(_first(PROMPT_KEYS)).alias("prompt"), T.redacted(_first(EXPECTED_KEYS)).alias("expected_behavior"),
        forbidden.alias("forbidden"), "evidence_id", critical.alias("critical"), "filename",
    )
    text = evidence_sections(sections.where(F.col("filename").isin(roles.tests))).withColumn("title", quoted_heading(F.col("quote"))).where("title <> ''")
    of_text = text.select(
        F.concat(F.lit("test-"), T.slug(F.col("filename")), F.lit("-"), T.slug(F.col("title"))).alias("id"), F.col("title").alias("name"), F.col("title").alias("prompt"), T.redacted(F.col("quote")).alias("expected_behavior"),
        F.array().cast("array<string>").alias("forbidden"), "evidence_id", F.lower("quote").rlike("|".join(CRITICAL_TEXT)).alias("critical"), "filename",
    )
    return of_rows.unionByName(of_text)


def tools(rows: DataFrame, roles: Roles | None = None) -> DataFrame:
    """``id, tool_name, category, allowed, needs_approval, input_policy, output_policy, reason, confidence``: each tool that rows ask for
    as its first row says, and the standard tools of which none speaks."""
    roles = roles or Roles()
    asked = rows.where(F.col("filename") == roles.tools).withColumn("tool_name", _first(["required_first_tool"])).where("tool_name <> ''")
    intent = F.coalesce(F.try_element_at("data", F.lit("user_intent_class")), F.lit("source-pack intent"))
    said = F.struct(
        T.split_values(_first(["allowed_followup_tools"])).alias("allowed"), T.redacted(_first(["blocking_conditions"])).alias("input_policy"), T.redacted(_first(["expected_final_action"])).alias("output_policy"),
        F.concat(F.lit("Required for "), intent, F.lit(".")).alias("reason"),
    )
    first = asked.groupBy("tool_name").agg(F.min_by(said, "row_number").alias("said"))
    standard = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in TOOLS])).alias("tool_name"))
    runtime = standard.join(first, "tool_name", "left_anti").select(
        "tool_name", F.lit("runtime").alias("category"), F.array().cast("array<string>").alias("allowed"), F.lit("Follow source-pack memory and tool policy.").alias("input_policy"), F.lit("Return grounded action or human handoff.").alias("output_policy"),
        F.concat("tool_name", F.lit(" is part of the compounding pharmacy tool policy.")).alias("reason"), F.lit(0.85).alias("confidence"),
    )
    both = first.select("tool_name", F.lit("tool_policy").alias("category"), "said.*", F.lit(0.9).alias("confidence")).withColumn("allowed", F.transform("allowed", T.redacted)).unionByName(runtime)
    return both.select(F.concat(F.lit("tool-"), T.slug(F.col("tool_name"))).alias("id"), (F.col("tool_name") == APPROVED_TOOL).alias("needs_approval"), "*")


def memory_notes(sections: DataFrame, roles: Roles | None = None) -> DataFrame:
    """One row ``notes``: the quotes of the policy files' sections in order, a line each, cut to so many characters.

    Each quote takes at least its line end, so no more sections than characters can count; Spark takes those without sorting all.
    """
    roles = roles or Roles()
    order = F.element_at(T.named({f: f"{k:06d}" for k, f in enumerate(roles.memory)}), F.col("filename"))
    text = evidence_sections(sections.where(F.col("filename").isin(roles.memory))).select(F.struct(order.alias("o"), F.col("start_line").alias("s"), F.coalesce("quote", F.lit("")).alias("q")).alias("x"))
    first = text.orderBy("x").limit(NOTES + 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["q"]), "\n")
    return first.agg(T.redacted(F.substring(joined, 1, NOTES)).alias("notes"))


def readiness(listed: DataFrame, made_facts: DataFrame, made_rules: DataFrame, evidence: DataFrame, made_gaps: DataFrame, made_tests: DataFrame) -> DataFrame:
    """One row ``status, score, blocking_reasons, n_warnings``; ``evidence`` has the ids of all evidence.

    Counts only: ``open_gaps`` gives the warnings that gaps add to the fixed ones.
    """
    loose = made_rules.join(evidence.select("evidence_id").distinct(), "evidence_id", "left_anti")
    count = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    parts = [
        count(listed, "sources"), count(made_facts, "facts"), count(made_rules, "rules"), count(listed.where("status <> 'published'"), "unpublished"), count(loose, "loose"),
        count(made_tests.where("critical AND evidence_id IS NULL"), "bare"), count(open_gaps(made_gaps), "open"),
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    n = {name: F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in ["sources", "facts", "rules", "unpublished", "loose", "bare", "open"]}
    blocking = F.array_compact(
        F.array(
            F.when(F.col("sources") == 0, "no_published_sources"), F.when(F.col("facts") + F.col("rules") == 0, "no_published_records"), F.when(F.col("unpublished") > 0, "source_without_published_status"),
            F.when(F.col("loose") > 0, "rule_without_evidence"), F.when(F.col("bare") > 0, "critical_test_without_evidence"),
        )
    )
    told = table.agg(*n.values()).select(blocking.alias("blocking_reasons"), (F.col("open") + len(WARNINGS)).alias("n_warnings"))
    score = F.greatest(F.lit(0), 100 - 2 * F.col("n_warnings") - 25 * F.size("blocking_reasons"))
    return told.select(F.when(F.size("blocking_reasons") > 0, "blocked").otherwise("warning").alias("status"), score.alias("score"), "blocking_reasons", "n_warnings")


def open_gaps(made_gaps: DataFrame) -> DataFrame:
    """``warning`` of each gap that is open or accepted."""
    told = F.coalesce(F.nullif("description", F.lit("")), F.nullif("id", F.lit("")), F.lit("open gap"))
    return made_gaps.where(F.col("status").isin("open", "accepted")).select(told.alias("warning"))


def digests(parts: dict[str, DataFrame]) -> DataFrame:
    """``section, n, digest`` of each part, independent of the order and place of its rows.

    The hash of each row is cut into four numbers, which are summed; so no task ever holds a section. Repeated rows count as often as they
    occur.
    """
    out = None
    for name, rows in parts.items():
        line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
        hashed = rows.select(F.sha2(line, 256).alias("h"))
        sums = [F.coalesce(F.sum(F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").cast("string") for k in range(4)]
        one = hashed.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("digest")).select(F.lit(name).alias("section"), "n", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def pack_digest(parts: dict[str, DataFrame]) -> DataFrame:
    """One row ``digest, version``: the digests of all parts by name; one for each part, however many rows they have."""
    listed = F.array_sort(F.collect_list(F.concat_ws(":", "section", "digest")))
    return digests(parts).agg(F.sha2(F.array_join(listed, "\n"), 256).alias("digest")).withColumn("version", F.concat(F.lit("ctx_"), F.substring("digest", 1, 12)))


def compiled(rows: DataFrame, sections: DataFrame, listed: DataFrame, roles: Roles | None = None) -> dict[str, DataFrame]:
    """All parts of a pack by name, each a frame of its own to be written."""
    links = linked(rows, sections)
    evidence = links.select(F.col("own_id").alias("id"), "quote", "filename").unionByName(evidence_sections(sections).select(F.col("evidence_id").alias("id"), "quote", "filename"))
    return {
        "sources": sources(listed), "evidence": evidence, "facts": facts(links, roles), "rules": rules(links, sections, roles), "gaps": gaps(rows, sections, roles), "tests": tests(links, sections, roles), "tools": tools(rows, roles),
        "memory": memory_notes(sections, roles),
    }
