"""A small pack of files of different shapes, compiled."""

import json

from pyspark.sql import functions as F

from kelpforge.operators import compiling as C

ROWS = "filename string, row_number long, document_type string, data map<string,string>"
TEXTS = "filename string, start_line long, heading string, body string"
RULES = "40_quote_rules_matrix.csv"


def pack(spark):
    rows = [
        ("04_allergens_excipients_triage.csv", 2, "risk-matrix", {"rule_id": "r1", "trigger": "nut", "anchor": "both"}),
        ("04_allergens_excipients_triage.csv", 3, "risk-matrix", {"anchor": "both", "x": "Bearer abc"}),
        ("14_known_gaps_and_publish_gates.csv", 2, "gaps", {"summary": "", "status": "closed"}),
        ("14_known_gaps_and_publish_gates.csv", 3, "gaps", {"gap_id": "g", "summary": "none", "severity": "high"}),
        ("30_price_catalog.csv", 2, "csv", {"price_id": "p", "evidence_anchor": "listed"}),
        ("30_price_catalog.csv", 5, "csv", {"price_id": "p", "evidence_anchor": ""}),
        ("59_synthetic_customer_query_eval_set.csv", 2, "tests", {"query": "q?", "forbidden_behavior": "a; ;b|c", "level": "HIGH"}),
        ("53_tool_calling_policy_matrix.csv", 9, "tools", {"required_first_tool": "create_quote", "allowed_followup_tools": "late"}),
        ("53_tool_calling_policy_matrix.csv", 4, "tools", {"required_first_tool": "create_quote", "allowed_followup_tools": "a,b", "user_intent_class": "buy"}),
        ("53_tool_calling_policy_matrix.csv", 5, "tools", {"required_first_tool": ""}),
    ]
    texts = [
        ("05_sales_triage_rules.md", 1, "Plain", "no marked line"),
        ("05_sales_triage_rules.md", 9, "Marked", "text\n#Later rule"),
        ("05_sales_triage_rules.md", 5, "Marked too", "x\n##Sooner rule\n#Evidence Anchors\n- `listed`\n- `both`\n#Else\n- `not`"),
        ("16_memory_and_tool_policy.md", 3, "Memory", "kept"),
        ("43_payment_discount_gap_policy.md", 1, "Discounts", "open"),
    ]
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame(texts, TEXTS)


def test_links_fall_back(spark):
    rows, texts = pack(spark)
    got = {(r.filename[:2], r.row_number): (r.evidence_id, r.own_id) for r in C.linked(rows, texts).collect()}
    text = {r.start_line: r.evidence_id for r in C.evidence_sections(texts).where("filename LIKE '05%'").collect()}
    assert got["04", 2][0] == got["04", 3][1] == got["04", 3][0]  # the last row that names the anchor
    assert got["30", 2][0] == got["30", 2][1] and got["30", 5][0] == got["30", 2][1]  # a row's own anchor, and the first of the file
    assert {e for e, _ in got.values()}.isdisjoint(text.values())
    assert [r.a for r in C.evidence_sections(texts).orderBy("filename", "start_line").select(C.quoted_anchors(F.col("quote")).alias("a")).collect()][1] == ["listed", "both"]


def test_records(spark):
    rows, texts = pack(spark)
    links = C.linked(rows, texts)
    facts = [(r.fact_type, json.loads(r.content)) for r in C.facts(links).collect()]
    assert sorted(x for x, _ in facts) == ["allergen_excipient"] * 2 + ["price"] * 2
    assert {"anchor": "both", "x": "[redacted]"} in [c["data"] for _, c in facts]
    rules = sorted((r.priority, r.rule_type, r.condition) for r in C.rules(links, texts).collect())
    assert [p for p, _, _ in rules] == list(range(100, 107))
    assert [t for _, t, _ in rules] == ["allergen_handoff"] * 2 + ["sales_triage"] * 2 + ["tool_policy"] * 3
    assert [json.loads(c).get("section") for _, t, c in rules if t == "sales_triage"] == ["Sooner rule", "Later rule"]
    assert json.loads(rules[0][2]) == {"trigger": "nut"} and "match" in json.loads(rules[1][2])
    gaps = {r.id: (r.kind, r.severity, r.status) for r in C.gaps(rows, texts).collect()}
    assert gaps == {"gap-2": ("publish_gap", "medium", "closed"), "g": ("publish_gap", "high", "open"), "gap-payment-discount-policy": ("commercial_gap_policy", "medium", "open")}
    (test,) = C.tests(links, texts).collect()
    assert (test.id, test.prompt, test.forbidden, test.critical) == ("test-row-2", "q?", ["a", "b", "c"], True)
    tools = {r.tool_name: (r.category, r.allowed, r.reason) for r in C.tools(rows).collect()}
    assert tools["create_quote"] == ("tool_policy", ["a", "b"], "Required for buy.") and len(tools) == len(C.TOOLS)
    assert C.memory_notes(texts).first().notes == "Memory: kept"


def test_readiness(spark):
    rows, texts = pack(spark)
    links = C.linked(rows, texts)
    made = C.gaps(rows, texts)
    evidence = links.select(F.col("own_id").alias("evidence_id")).union(C.evidence_sections(texts).select("evidence_id"))
    listed = C.sources(rows.select("filename", "document_type").distinct())
    row = C.readiness(listed, C.facts(links), C.rules(links, texts), evidence, made, C.tests(links, texts)).first()
    assert (row.status, row.score, row.blocking_reasons, row.n_warnings) == ("warning", 88, [], 6)
    none = C.readiness(listed.limit(0), C.facts(links).limit(0), C.rules(links, texts), evidence.limit(0), made.limit(0), C.tests(links, texts).withColumn("evidence_id", F.lit(None).cast("string"))).first()
    assert none.status == "blocked" and none.score == 17 and none.blocking_reasons == ["no_published_sources", "rule_without_evidence", "critical_test_without_evidence"]


def test_numbers_run_through_blocks_and_files(spark):
    made = spark.range(10000).select(F.when(F.col("id") < 7000, "b").otherwise("a").alias("filename"), (F.col("id") * 3).alias("place"))
    got = [(r.filename, r.place) for r in C.numbered(made.repartition(7), ["b", "c", "a"], 5).orderBy("priority").collect()]
    assert got == [("b", 3 * k) for k in range(7000)] + [("a", 3 * k) for k in range(7000, 10000)]
    assert [r.priority for r in C.numbered(made, ["b", "c", "a"], 5).orderBy("priority").collect()] == list(range(5, 10005))
    assert C.numbered(made.limit(0), ["a"], 1).count() == 0


def test_same_pack_same_digest(spark):
    rows, texts = pack(spark)
    listed = rows.select("filename", "document_type").distinct()
    digest = lambda r, t: C.pack_digest(C.compiled(r, t, listed)).first()
    first = digest(rows, texts)
    assert digest(rows.repartition(5), texts.orderBy("heading")) == first and first.version == "ctx_" + first.digest[:12]
    assert digest(rows.where("row_number < 9"), texts).digest != first.digest
    twice = {r.section: r.digest for r in C.digests({"a": rows.select("filename"), "b": rows.select("filename").union(rows.select("filename"))}).collect()}
    assert twice["a"] != twice["b"]


def test_tables_and_problems(spark):
    tables = spark.createDataFrame([("x/f.csv", 2, ["a", "b", "a"], ["1", "2", "3"]), ("x/g.csv", 2, ["a", "b"], ["1"]), ("x/h.csv", None, None, None)], "path string, row_index int, headers array<string>, cells array<string>")
    listed = spark.createDataFrame([("f.csv", "catalog")], "filename string, document_type string")
    got = {r.filename: (r.document_type, r.data) for r in C.rows_of_tables(tables, listed).collect()}
    assert got == {"f.csv": ("catalog", {"b": "2", "a": "3"}), "g.csv": ("csv", {"a": "1", "b": ""})}
    files = spark.createDataFrame([("a", ""), ("b", "fine"), ("c", "x password=1"), ("d", None)], "filename string, text string")
    assert {(r.filename, r.problem) for r in C.problems(files).collect()} == {("a", "empty"), ("d", "empty"), ("c", "forbidden_marker:password=")}
