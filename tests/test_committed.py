import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from kelpforge.sources import committed as C


@pytest.fixture
def store(spark, tmp_path):
    return C.Store(spark, str(tmp_path / "store"))


def ingest(spark, store, key, sources, text, passed=True):
    jobs = spark.createDataFrame([(f"{key}{s}", s) for s in sources], "job_key string, source_id long")
    reports = spark.createDataFrame([(s, passed, None if passed else "too_short", "") for s in sources], "source_id long, passed boolean, rejection_reason string, warnings string")
    chunks = spark.createDataFrame([(s, k, f"{text} {s} {k}") for s in sources for k in range(s) if passed], "source_id long, chunk_index int, content string")
    return C.complete_ingest(store, jobs, reports, chunks)


def content(store, until=None):
    return sorted((r.source_id, r.content) for r in store.read("chunks", until).collect())


def test_reload_replaces_a_source_and_nothing_else(spark, store):
    assert ingest(spark, store, "a", [1, 2], "old") == 1
    assert ingest(spark, store, "b", [2, 3], "new") == 2
    assert content(store) == [(1, "old 1 0"), (2, "new 2 0"), (2, "new 2 1"), (3, "new 3 0"), (3, "new 3 1"), (3, "new 3 2")]
    assert content(store, until=1) == [(1, "old 1 0"), (2, "old 2 0"), (2, "old 2 1")]
    assert ingest(spark, store, "c", [3], "bad", passed=False) == 3
    assert [s for s, _ in content(store)] == [1, 2, 2]
    assert {(r.source_id, r.is_processable, r.decision) for r in store.read("quality_reports").collect()} == {(1, True, "passed"), (2, True, "passed"), (3, False, "too_short")}
    assert {(r.job_key, r.status, r.records) for r in store.read("jobs").collect()} == {("a1", "succeeded", 1), ("a2", "succeeded", 2), ("b2", "succeeded", 2), ("b3", "succeeded", 3), ("c3", "succeeded", 0)}


def test_a_repeated_job_changes_nothing(spark, store):
    ingest(spark, store, "a", [1, 2], "old")
    before = content(store)
    assert ingest(spark, store, "a", [1, 2, 1], "other") is None and store.numbers() == [1]
    assert content(store) == before


@pytest.mark.parametrize("survived", range(6))
def test_a_writer_lost_between_any_two_writes_leaves_the_old_version(spark, store, monkeypatch, survived):
    ingest(spark, store, "a", [1, 2], "old")
    before, jobs, real, done = content(store), store.read("jobs").count(), DataFrameWriter.parquet, []

    def write(self, *args, **more):
        if len(done) == survived:
            raise RuntimeError("lost")
        done.append(args)
        return real(self, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    if survived == 5:  # all is written, only the rename is left
        monkeypatch.setattr(C.Store, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        ingest(spark, store, "b", [2, 3], "new")
    monkeypatch.undo()
    assert content(store) == before and store.read("jobs").count() == jobs and store.numbers() == [1]
    assert ingest(spark, store, "b", [2, 3], "new") == 2 and len(content(store)) == 6


def test_chunks_are_worked_out_once(spark, store):
    calls = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (calls.add(1), x)[1], "string")
    jobs = spark.createDataFrame([("a1", 1), ("a2", 2)], "job_key string, source_id long")
    reports = spark.createDataFrame([(1, True, None, "")], "source_id long, passed boolean, rejection_reason string, warnings string")
    chunks = spark.createDataFrame([(1, k, f"text {k}") for k in range(7)], "source_id long, chunk_index int, content string").withColumn("chunk_id", seen("content"))
    C.complete_ingest(store, jobs, reports, chunks.where("chunk_id <> ''"))
    assert {(r.job_key, r.records) for r in store.read("jobs").collect()} == {("a1", 7), ("a2", 0)} and len(content(store)) == 7
    assert calls.value <= 14  # once in the filter and once in the rows; counting them reads what was written


def test_of_two_writers_one_wins(spark, store):
    ingest(spark, store, "a", [1], "old")
    keys = spark.createDataFrame([(1,)], "source_id long")
    rows = lambda x: spark.createDataFrame([(1, 0, x, "pending")], "source_id long, chunk_index int, content string, status string")
    none = spark.createDataFrame([], "job_key string")
    one, two = (store.stage(C.Change(none).replace("chunks", keys, "source_id", rows(x))) for x in ("one", "two"))
    store.publish(*one)
    with pytest.raises(Exception):  # noqa: B017
        store.publish(*two)
    assert content(store) == [(1, "one")]


def test_classification_and_extraction(spark, store):
    jobs = lambda *rows: spark.createDataFrame(list(rows), "job_key string, source_id long, chunk_id string")
    decided = spark.createDataFrame([("x", "classified", "price"), ("y", "unknown", None), ("z", "classified", "not mine")], "chunk_id string, status string, classification string")
    unknown = spark.createDataFrame([("y", "??", None, 0.2)], "chunk_id string, raw_text string, suggested_type string, confidence double")
    queued = spark.createDataFrame([("x", "e1"), ("x", "e1"), ("x", "e2"), ("z", "e3")], "chunk_id string, job_key string")
    assert C.complete_classification(store, jobs(("c1", 7, "x"), ("c2", 7, "y")), decided, unknown, queued) == 1
    assert C.complete_classification(store, jobs(("c1", 7, "x")), decided, unknown, queued) is None
    assert {(r.job_key, r.kind, r.status, r.records) for r in store.read("jobs").collect()} == {("c1", "classification", "succeeded", 2), ("c2", "classification", "succeeded", 0), ("e1", "extraction", "queued", 0), ("e2", "extraction", "queued", 0)}
    status = spark.createDataFrame([("e1", "extracted")], "job_key string, status string")
    spans = spark.createDataFrame([("e1", "10 reais", 0, 8)], "job_key string, quote string, char_start int, char_end int")
    records = spark.createDataFrame([("e1", "fact", "price", "{}", 0.9), ("e1", "rule", "discount", "{}", 0.8), ("e9", "fact", "x", "{}", 1.0)], "job_key string, kind string, type string, payload string, confidence double")
    left = spark.createDataFrame([], "job_key string, raw_text string")
    assert C.complete_extraction(store, jobs(("e1", 7, "x")), status, spans, records, left) == 2
    found = store.read("records").collect()
    assert {(r.kind, r.status) for r in found} == {("fact", "extracted"), ("rule", "extracted")} and len({r.evidence_id for r in found} - {None}) == 1
    assert {(r.chunk_id, r.status, r.classification) for r in store.read("chunk_states").collect()} == {("x", "extracted", "price"), ("y", "unknown", None)}
    assert {(r.job_key, r.status, r.records) for r in store.read("jobs").where("kind = 'extraction'").collect()} == {("e1", "succeeded", 2), ("e2", "queued", 0)}
    # a late classification of the same chunk finds the finished extraction job and leaves it alone
    assert C.complete_classification(store, jobs(("c3", 7, "x")), decided, unknown, queued) == 3
    assert {(r.job_key, r.status) for r in store.read("jobs").where("kind = 'extraction'").collect()} == {("e1", "succeeded"), ("e2", "queued")}


def test_compacting_keeps_the_rows(spark, store):
    ingest(spark, store, "a", [1, 2], "old")
    ingest(spark, store, "b", [2], "new")
    before = content(store)
    assert store.compact("chunks", "source_id") == 3 and content(store) == before and content(store, until=2) == before
    with pytest.raises(KeyError):
        store.read("nothing")
