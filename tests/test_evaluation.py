from pyspark.sql import functions as F

from kelpforge.functions import trees as T
from kelpforge.operators import evaluation as E
from kelpforge.operators import grounding as G
from kelpforge.sources.committed import Store

DEEP = '{"b": {"x": [1, [2, {"y": {"z": "}]\\" end"}}]], "e": {}, "n": null}, "name": "A", "amount": 10.5, "flag": false}'


def test_leaves_of_any_depth(spark):
    rows = spark.createDataFrame([(1, DEEP), (2, None), (3, "no json"), (4, "7"), (5, "[]")], "id long, doc string")
    got = {(r.id, r.path): r.text for r in T.leaves(rows, "doc").select("id", "path", T.leaf_text(F.col("value")).alias("text")).collect()}
    assert got == {(1, "b.x[0]"): "1", (1, "b.x[1][0]"): "2", (1, "b.x[1][1].y.z"): '}]" end', (1, "b.n"): "", (1, "name"): "A", (1, "amount"): "10.5", (1, "flag"): "False", (4, ""): "7"}
    plain = {(r.id, r.path) for r in T.leaves(rows, "doc", arrays=False).collect()}
    assert (1, "b.x") in plain and (5, "") in plain and not any("[" in p for _, p in plain)
    text = {r.id: r.canonical for r in T.canonical_text(rows, "doc", "id").collect()}
    assert text == {1: 'A 10.5 1 2 }]" end False', 2: "", 3: "", 4: "7", 5: ""}
    assert T.leaves(rows.limit(0), "doc").count() == 0


def test_expectations(spark):
    expected = spark.createDataFrame([(1, "a", False), (1, "b", True), (2, "a", False), (3, "b", True)], "key long, code string, negative boolean")
    observed = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (9, "b")], "key long, code string")
    row = E.expectations(expected, observed, []).first()
    assert (row.positives, row.hits, row.negatives, row.passes) == (2, 1, 2, 1)


def test_confusion(spark):
    cases = spark.createDataFrame([("clean", "passed", "passed"), ("clean", "passed", "failed"), (None, "failed", "passed"), (None, "failed", "failed")], "modality string, expected string, actual string")
    got = {r.modality: (r.cases, r.false_pass, r.false_fail, r.false_fail_rate, r.accuracy) for r in E.confusion(cases).collect()}
    assert got == {"clean": (2, 0, 1, 0.5, 0.5), "unspecified": (2, 1, 0, 0.0, 0.5), None: (4, 1, 1, 0.5, 0.5)}


def test_scope(spark):
    truth = spark.createDataFrame([("f", "k", "t")] * 3, "filename string, kind string, type string")
    found = spark.createDataFrame([("f", "k", "t", 1), ("f", "k", "u", 2), ("g", "k", "t", 3)], "filename string, kind string, type string, n int")
    assert [r.n for r in E.scoped(found, truth, ["filename", "kind", "type"]).collect()] == [1]


def test_a_second_run_asks_for_new_keys_only(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def model(claims):
        asked.add(len(claims))
        return ["supported" if "1" in c["claim"] else "contradicted" for c in claims]

    schema = "claim_id long, fact_type string, claim string, chunk string, quote string, char_start int, char_end int"
    row = lambda k, n: (k, "service_price", f'{{"a": {n}}}', "Price is 10", "is 10", None, None)
    store = Store(spark, str(tmp_path / "store"))
    first = {r.claim_id: r.entailment for r in G.grounded_once(store, spark.createDataFrame([row(1, 1), row(2, 1), row(3, 2)], schema), model).collect()}
    assert first == {1: "passed", 2: "passed", 3: "failed"} and asked.value == 2
    grown = spark.createDataFrame([row(1, 1), row(3, 2), row(4, 3), (5, "service_price", "{}", "Price", "absent", None, None)], schema)
    again = G.grounded_once(store, grown, model)
    got = {r.claim_id: (r.entailment, r.blocks) for r in again.collect()}
    assert got == {1: ("passed", False), 3: ("failed", True), 4: ("failed", True), 5: ("failed", True)} and asked.value == 3
    again.collect()
    assert asked.value == 3
