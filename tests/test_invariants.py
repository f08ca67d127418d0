import hashlib

import pytest
from pyspark.sql import functions as F

from kelpforge.operators import invariants as I

CHUNK = "doc_id long, text string, char_count int, chunk_hash string, source_page int, page_start int, page_end int, row_start int, row_end int, sheet_name string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(
    "change, broken",
    [
        ({}, False), ({"text": " "}, True), ({"text": None}, True), ({"char_count": 9}, True), ({"chunk_hash": "x"}, True), ({"page_end": None}, True), ({"page_start": 3}, True), ({"page_start": 0}, True),
        ({"source_page": 3}, True), ({"source_page": 2}, False), ({"page_start": None, "page_end": None}, True), ({"page_start": None, "page_end": None, "source_page": 4}, False),
        ({"row_start": 1, "row_end": 2}, True), ({"row_start": 1, "row_end": 2, "sheet_name": "s"}, False), ({"row_start": 2, "row_end": 1, "sheet_name": "s"}, True), ({"row_start": 1, "sheet_name": "s"}, True),
    ],
)
def test_chunks(spark, change, broken):
    row = {"doc_id": 1, "text": "abc", "char_count": 3, "chunk_hash": digest("abc"), "source_page": None, "page_start": 1, "page_end": 2, "row_start": None, "row_end": None, "sheet_name": None} | change
    frame = spark.createDataFrame([tuple(row.values())], CHUNK)
    assert frame.where(I.chunk_broken(frame.columns)).count() == broken


def test_quotes_and_pages(spark):
    pages = spark.createDataFrame([(1, 1, "one two"), (1, 2, "three"), (2, 5, "x")], "doc_id long, page_number int, text string")
    rows = [(1, "a", " two ", 1, 1), (1, "b", "two", 2, 2), (1, "c", "three", None, None), (1, "d", "four", None, None), (1, "visual_risk", None, 1, 2), (1, "e", "", 1, 1), (2, "f", "x", 5, None), (2, "g", "x", 5, 6), (3, "h", "x", 1, 1), (1, "a", " two ", 1, 1)]
    got = I.quoted(spark.createDataFrame(rows, "doc_id long, kind string, quote string, page_start int, page_end int"), pages).collect()
    assert len(got) == 10 and {r.kind for r in got if r.unquoted} == {"b", "d", "e", "h"} and {r.kind for r in got if r.misplaced} == {"f", "g", "h"}


def test_packets(spark):
    schema = "packet_id string, doc_id long, reason_code string, severity string, suggested_decision string, risk_code string, section_path string, page_number int, evidence_count long"
    good = ("1:visual", 1, "visual_table_figure_risk", "medium", "inspect_visual_evidence", "visual_content_without_caption", None, 1, 1)
    change = lambda **c: tuple((dict(zip([x.split()[0] for x in schema.split(", ")], good, strict=True)) | c).values())
    rows = [good, change(packet_id="a b", page_number=2), change(packet_id="c", page_number=3, reason_code="new"), change(packet_id="d", page_number=4, severity="odd"), change(packet_id="e", page_number=5, evidence_count=0)]
    rows += [change(packet_id="f", page_number=6, reason_code="missing_metadata", evidence_count=0, risk_code="missing_revision"), change(packet_id="g", page_number=7, risk_code="odd"), change(packet_id="h"), change(packet_id="i", page_number=8), change(packet_id="i", page_number=9)]
    got = I.judged_packets(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.packet_id for r in got if r.malformed) == ["a b", "c", "d", "e", "g", "i", "i"] and sorted(r.packet_id for r in got if r.repeated) == ["1:visual", "h"] and len(got) == 10


def test_counts_are_gathered_by_the_job_that_writes(spark, tmp_path):
    chunks = spark.createDataFrame([(k, "abc", 3 + (k == 7), digest("abc"), 1, 1, 1, None, None, None) for k in range(20)], CHUNK).repartition(3)
    watch, calls = I.Watch(witnesses=2), spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (calls.add(1), x)[1], "string")
    watched = chunks.withColumn("text", seen("text"))
    watch.over("chunks", watched, spans=I.chunk_broken(chunks.columns), risks=I.unknown_risk(F.lit(""))).write.parquet(str(tmp_path / "out"))
    report = {r["invariant"]: r for r in watch.report()}
    assert (report["risks"]["checked"], report["risks"]["violations"], report["risks"]["witnesses"]) == (20, 0, [])
    assert report["spans"]["violations"] == 1 and [w["doc_id"] for w in report["spans"]["witnesses"]] == [7]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_changes(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, text string")
    after = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "d")], "k long, text string")
    assert sorted(r.k for r in I.changed(before, after, ["k"], ["text"]).collect() if r.changed) == [2, 4]
