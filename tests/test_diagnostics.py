from pyspark.sql import functions as F

from kelpforge.operators import diagnostics as G
from kelpforge.operators import review

CHUNK = "doc_id long, chunk_hash string, page_start int, section_path string, text string"


def test_candidates_of_lines(spark):
    text = "a | b | c\r\n\n[ ] Lavar: ok - NÃO\n[x] Só marcar\n\nFigura 2 - Planta\nx  y  z\nvide anexo II"
    chunks = spark.createDataFrame([(1, "h", 3, None, text), (2, "i", None, "1/1.1", None), (3, "j", None, "1", "nothing here")], CHUNK)
    got = {r.candidate_id: (r.kind, r.label, r.detail, r.row_count) for r in G.visual_candidates(chunks).collect()}
    assert got == {
        "h:3:unsectioned:table:0": ("text_table", None, None, 2), "h:3:unsectioned:checklist:1": ("checklist_row", "Lavar", "ok - não", None), "h:3:unsectioned:checklist:2": ("checklist_row", "Só marcar", "checked", None),
        "h:3:unsectioned:figure:3": ("figure_reference", "Figura 2", "Planta", None), "h:3:unsectioned:figure:5": ("figure_reference", "anexo II", "", None),
    }
    assert G.visual_candidates(chunks.limit(0)).count() == 0


def test_risks(spark):
    found = spark.createDataFrame([(1, 1, "figure_reference", "Planta"), (1, 2, "figure_reference", "Ver nota"), (1, 3, "figure_reference", "- sem legenda"), (1, 4, "text_table", "Planta")], "doc_id long, page_number int, kind string, detail string")
    profiles = spark.createDataFrame([(1, k, 1, 10, "b,a") for k in range(1, 6)] + [(1, 6, 1, 900, ""), (1, None, 1, 1, "")], "doc_id long, page_number int, image_count long, text_chars long, risk_codes string")
    got = {r.page_number: r.risk_codes for r in G.visual_risks(profiles, found).collect()}
    assert got == dict.fromkeys([2, 3, 4, 5], "a,b,visual_content_without_caption")


def test_tallies(spark):
    rows = spark.createDataFrame([(1, "a", ["x", "y", "x"]), (1, None, None), (2, "", []), (2, "a", ["y"])], "doc_id long, kind string, risks array<string>")
    made = G.tally(rows, "rows", {"kind": F.col("kind"), "risk": F.col("risks")})
    assert {(r.doc_id, r.measure, r.key): r.n for r in made.collect()} == {(1, "rows", None): 2, (2, "rows", None): 2, (1, "kind", "a"): 1, (2, "kind", "a"): 1, (1, "risk", "x"): 2, (1, "risk", "y"): 1, (2, "risk", "y"): 1}
    assert {(r.measure, r.key): r.n for r in G.summed([made, made]).collect()} == {("rows", None): 8, ("kind", "a"): 4, ("risk", "x"): 4, ("risk", "y"): 4}


def test_expected_and_packets(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "file_name string")
    assert {r.file_name: r.present for r in G.expected_documents(names("a", "b", "a"), names("b", "c")).collect()} == {"a": False, "b": True}
    spans = spark.createDataFrame([(1, "gap", "1", 4), (1, "gap", "1", 2), (1, "", "2", 1)], "doc_id long, risk string, section_path string, page_number int")
    docs = spark.createDataFrame([(1, "gap"), (1, "edge"), (2, "edge"), (2, "edge")], "doc_id long, risk string")
    got = {r.packet_id: (r.section_path, r.page_number, r.evidence_count) for r in review.section_packets(spans, docs).collect()}
    name = "ambiguous_section_hierarchy"
    assert got == {f"1:{name}:gap": ("1", 2, 2), f"1:{name}:edge": (None, None, 1), f"2:{name}:edge": (None, None, 1)}
