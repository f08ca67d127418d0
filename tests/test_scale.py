"""Steps that grow with the input are worked out once a row, and give what the plain ones give."""

from pyspark.sql import functions as F

from kelpforge import plans
from kelpforge.functions import text as X
from kelpforge.operators import documents as D
from kelpforge.operators import invariants as I
from kelpforge.operators import readpath as P
from kelpforge.operators import retrieval as Q

SF = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_trimmed_is_the_regular_expression(spark):
    signs = [chr(k) for k in (*range(0x3100), 0xFEFF)]
    rows = [(s + "a" + s + "b" + s,) for s in signs] + [(s,) for s in signs] + [("",), (None,), (" \t　x \n",)]
    frame = spark.createDataFrame(rows, "s string").select(X.trimmed(F.col("s")).alias("a"), F.regexp_replace("s", r"(?U)^\s+|\s+$", "").alias("b"))
    assert frame.where("NOT a <=> b").count() == 0


def test_sensitive_lines_need_few_identifiers(spark, tmp_path):
    lines = [
        "the api key", "A-P-I K.E.Y", "Supplier  Price", "s u p p l i e r p r i c e", "cústo", "margem de lucro", "TOKEN", "toKen", "tokens", "plain", "", "cost_of", "accosted", "supplier prices",
        "  i n t e r n a l_notes ", "internal notes too", "credentiaĺs", "secrét", "İnternal notes", "api\rkey",
    ]
    texts = [(1, "\n".join(lines)), (2, None), (3, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = plans.QUERIES["sensitive_lines"](spark, str(tmp_path))
    ident = X.identifier(F.lower("s"))
    plain = spark.createDataFrame([(k, s) for k, s in enumerate(lines)], "k int, s string").select("k", ident.alias("i"))
    want = sorted((r.k, r.i) for r in plain.where(X.names_sensitive(F.col("i"))).collect())
    assert sorted((r.line_index, r.ident) for r in frame.collect()) == want and len(want) > 9
    assert plan_of(frame).count("[^a-z0-9]+") <= 2  # in the filter and in the result; before, once for each word looked for


def sources(frame):
    return sum("documents.parquet" in x for x in frame.inputFiles())


def test_spans_read_stored_lines(spark):
    assert sources(plans.QUERIES["industrial_chunks"](spark, SF)) == 0  # lines, spans and boilerplate are worked out once
    assert sources(plans.QUERIES["structure_hints"](spark, SF)) == 0


def test_narrow_rows_are_dealt_over_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    for name in ("document_metadata", "json_leaves"):
        frame = plans.QUERIES[name](spark, SF)  # of a file that Spark reads in one task
        assert frame.select(F.spark_partition_id().alias("p")).distinct().count() >= cores


def test_invariants_read_stored_pages(spark):
    frame = plans.QUERIES["invariant_report"](spark, SF)
    assert sources(frame) == 0  # pages, profiles and packets are worked out once


def test_pages_that_are_compared_meet_as_hashes(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (5, "")], "k long, text string")
    after = spark.createDataFrame([(1, "a"), (2, "c"), (3, ""), (4, "d"), (5, "")], "k long, text string")
    frame = I.changed(before, after, ["k"], ["text"])
    assert sorted(r.k for r in frame.collect() if r.changed) == [2, 3, 4]
    assert plan_of(frame).count("sha2(") == 2


def test_quotes_are_held_against_pages_before_the_next_join(spark):
    rows = spark.createDataFrame([(1, "a", " two ", 1, 1), (1, "b", "six", 1, 3)], "doc_id long, kind string, quote string, page_start int, page_end int")
    pages = spark.createDataFrame([(1, 1, "one two"), (1, 2, "three")], "doc_id long, page_number int, text string")
    frame = I.quoted(rows, pages)
    assert {(r.kind, r.unquoted, r.misplaced) for r in frame.collect()} == {("a", False, False), ("b", True, True)}
    over_documents = next(x for x in plan_of(frame).splitlines() if "Project [" in x and "_n#" in x and "_least#" in x)
    assert "_here#" in over_documents and "_page#" not in over_documents


def test_pages_of_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, "\n"), (4, "\n".join(map(str, range(10)))), (5, "\n".join(map(str, range(21)))), (6, "\n" * 10)]
    got = {(r.doc_id, r.page_number): r.text for r in D.pages(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    want = {}
    for k, text in texts:
        lines = (text or "").split("\n")
        want |= {(k, p // 10 + 1): "\n".join(lines[p : p + 10]) for p in range(0, len(lines), 10)}
    assert got == want


def test_columns_of_lines(spark):
    lines = ["a  b  c", "a  b", " a  b  ", "a | b | c", "a|b", "a \t b\t\tc", "  a b c  ", "a  b\t c", "", "  ", "||"]
    frame = spark.createDataFrame([(x,) for x in lines], "s string").select("s", D.is_table_line(F.col("s")).alias("t"))
    assert {r.s for r in frame.collect() if r.t} == {"a  b  c", "a | b | c", "a \t b\t\tc", "a  b\t c", "||"}


def test_records_meet_questions_some_at_a_time(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(Q, "MATCHED", 5)
    records = spark.createDataFrame([(k, f"alpha beta{k % 3} word{k} alpha") for k in range(100)] + [(100, ""), (101, "zz")], "record_id long, text string")
    questions = spark.createDataFrame([(1, "alpha beta1"), (2, "word7 Word7"), (3, "")], "question_id long, question string")
    questions.write.parquet(str(tmp_path / "questions"))  # a small side whose size is known
    frame = Q.matches(spark.read.parquet(str(tmp_path / "questions")), records)
    got = {(r.question_id, r.record_id): r.lexical for r in frame.collect()}
    assert got == {(1, k): 1 + (k % 3 == 1) for k in range(100)} | {(2, 7): 1}
    assert frame.rdd.getNumPartitions() >= 21  # before, as many as there are shuffle partitions, however many records


INDEX = [(0.9, "e1", "Hex Bolt", "bolt", True), (0.9, "e0", "screw", "bolt", True), (0.5, "e2", "thing", "red bolt", False), (0.1, "e3", "x", "", True)]


def test_rewriting_with_a_short_and_a_long_index(spark, monkeypatch):
    index = spark.createDataFrame(INDEX, "score double, entity_id string, corpus_term string, user_term string, published boolean")
    queries = spark.createDataFrame([(k, "a Red  bolt" if k % 2 else None, 0.1) for k in range(40)], "query_id long, query string, recall double")
    made = lambda: P.transformed(queries, index, corpus_id="c", version="v", published_only=False)
    monkeypatch.setattr(P, "REWRITTEN", 4)
    short = made()
    assert "strategy=broadcast" in plan_of(short) and short.rdd.getNumPartitions() >= 10
    want = sorted(short.collect())
    assert {(r.rewritten, r.grounded) for r in want} == {("", ""), ("a red bolt", "a red screw hex bolt thing")} and len(want) == 40
    monkeypatch.setattr(P, "SMALL_INDEX", 3)
    long = made()
    assert "strategy=merge" in plan_of(long) and "strategy=broadcast" not in plan_of(long)
    assert sorted(long.collect()) == want
