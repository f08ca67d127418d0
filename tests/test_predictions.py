import json

from pyspark.sql import functions as F

from kelpforge.operators import predictions as R

FACTS = "id string, source_id string, fact_type string, content string, normalized_content string, evidence_quote string, status string"
RULES = "id string, source_id string, rule_type string, condition string, action string, evidence_quote string, status string"
UNKNOWN = "id string, source_id string, suggested_fact_type string, metadata string, status string"


def test_export(spark):
    facts = spark.createDataFrame([("1", "s", "t", '{"text": "b", "name": "a"}', "{}", None, None), ("2", "x", "t", None, "{}", "", "published"), ("3", "s", "t", None, None, "said", "published")], FACTS)
    rules = spark.createDataFrame([("1", "s", "r", '{"day": "mon"}', '{"a": [1, {"b": true}]}', None, "published"), ("4", "s", "r", "{}", None, "", "published")], RULES)
    unknowns = spark.createDataFrame([("7", None, "", '{"reason": ""}', "open"), ("8", "s", "kind", None, "schema_requested"), ("9", "s", "kind", None, "ignored")], UNKNOWN)
    sources = spark.createDataFrame([("s", "f.csv")], "id string, original_filename string")
    got = {(r.record_kind, r.id): r for r in R.exported(facts, rules, unknowns, sources).collect()}
    assert set(got) == {("fact", "1"), ("fact", "3"), ("rule", "1"), ("review_signal", "7"), ("review_signal", "8")}
    assert {k: r.canonical for k, r in got.items()} == {("fact", "1"): "a b", ("fact", "3"): "", ("rule", "1"): "mon 1 True", ("review_signal", "7"): "unknown", ("review_signal", "8"): "kind"}
    assert got["review_signal", "7"].source_filename == "" and got["fact", "1"].source_filename == "f.csv" and got["fact", "1"].status == "published"
    assert json.loads(got["rule", "1"].content) == {"condition": {"day": "mon"}, "action": {"a": [1, {"b": True}]}}
    assert R.exported(facts.limit(0), rules.limit(0), unknowns.limit(0), sources).count() == 0


def test_published_view_first(spark):
    facts = spark.createDataFrame([("1", "published"), ("2", "draft")], "id string, status string")
    view = spark.createDataFrame([("5", "published")], "id string, status string")
    assert [r.id for r in R.live(view, facts).collect()] == ["5"] and [r.id for r in R.live(view.limit(0), facts).collect()] == ["1"]


def test_one_source_reads_one_directory(spark, tmp_path):
    hot = spark.range(9000).select((F.col("id") % 3).alias("workspace_id"), F.when(F.col("id") < 6000, 1).otherwise(F.col("id") % 200).cast("string").alias("source_id"), "id")
    store = R.Clustered(str(tmp_path), 8)
    store.write("jobs", hot)
    store.write("empty", hot.limit(0))
    found = store.read(spark, "jobs", 1, "1")
    assert found.count() == hot.where("workspace_id = 1 AND source_id = '1'").count() > 2000
    all_files, read = spark.read.parquet(f"{tmp_path}/jobs_8").inputFiles(), found._jdf.queryExecution().executedPlan().toString()
    folders = {f.rsplit("/", 1)[0] for f in all_files}
    assert len(folders) == 24 and len({r.d for r in found.select(F.regexp_extract(F.input_file_name(), "(.*)/", 1).alias("d")).distinct().collect()}) == 1
    assert "PartitionFilters: [isnotnull(workspace_id" in read and "(bucket#" in read
    assert {r.table_name: r.rows for r in store.report(spark, ["jobs", "empty"], 1, "1").collect()} == {"jobs": found.count(), "empty": 0}
    counts = {(r.workspace_id, r.source_id): (r.jobs, r.none) for r in R.source_counts({"jobs": hot, "none": hot.limit(0)}, ["workspace_id", "source_id"]).collect()}
    assert counts[1, "1"] == (found.count(), 0) and sum(n for n, _ in counts.values()) == 9000
