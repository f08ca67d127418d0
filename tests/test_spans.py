from pyspark.sql import functions as F

from kelpforge.operators import spans as S

LINED = "doc_id long, page_number int, line_index int, line string"
RAW = "doc_id long, page_start int, page_number int, page_end int, line_index int, section_path string, section_title string, title string, kind string, risk_codes array<string>"


def lined(spark, pages, doc=1):
    return spark.createDataFrame([(doc, p, k, x) for p, lines in pages.items() for k, x in enumerate(lines)], LINED)


def none(spark):
    return spark.createDataFrame([], "doc_id long, page_number int, line_index int")


def test_a_section_goes_on_until_the_next_heading_in_the_middle_of_a_page(spark):
    pages = {1: ["before any heading", "1 Escopo geral", "Texto do escopo " * 5], 2: ["resto do escopo " * 5, "rodape 2", "2 Metodo novo", "Texto do metodo " * 5]}
    spans = [(1, 1, None, None, 1, "1", "Escopo geral", None, "numbered_section", ["b", "a", "a", ""]), (1, None, 2, None, 2, "2", None, "Metodo novo", "numbered_section", None), (1, None, None, None, 0, "3", "x", None, "k", None), (1, 1, None, None, 2, "", "x", None, "k", None)]
    normal = S.normalized_spans(spark.createDataFrame(spans, RAW))
    assert {(r.section_path, r.page_start, r.page_end, tuple(r.risk_codes)) for r in normal.collect()} == {("1", 1, 1, ("a", "b")), ("2", 2, 2, ())}
    footer = spark.createDataFrame([(1, 2, 1)], "doc_id long, page_number int, line_index int")
    got = S.industrial_chunks(lined(spark, pages), normal, footer).orderBy("chunk_index").collect()
    assert [(r.section_path, r.page_start, r.page_end, r.risk_codes) for r in got] == [("1", 1, 2, "a,b"), ("2", 2, 2, "")]
    assert "resto do escopo" in got[0].text and "rodape" not in got[0].text and "before" not in got[0].text and got[0].char_count == len(got[0].text)


def test_a_page_that_begins_with_a_heading_stops_the_section_before(spark):
    pages = {1: ["1 Um", "texto um " * 9], 2: ["perdido " * 9], 3: ["2 Dois", "texto dois " * 9]}
    spans = spark.createDataFrame([(1, 1, None, None, 0, "1", "Um", None, "k", None), (1, 3, None, None, 0, "2", "Dois", None, "k", None)], RAW)
    got = S.industrial_chunks(lined(spark, pages), S.normalized_spans(spans), none(spark)).collect()
    assert {(r.section_path, r.page_start, r.page_end) for r in got} == {("1", 1, 1), ("2", 3, 3)} and not any("perdido" in r.text for r in got)


def test_a_declared_end_beyond_the_next_heading_repeats_its_pages(spark):
    pages = {1: ["1 Um", "texto um " * 9], 2: ["2 Dois", "texto dois " * 9], 3: ["fim " * 20]}
    spans = spark.createDataFrame([(1, 1, None, 3, 0, "1", "Um", None, "k", None), (1, 2, None, 3, 0, "2", "Dois", None, "k", None)], RAW)
    got = {r.section_path: r.text for r in S.industrial_chunks(lined(spark, pages), S.normalized_spans(spans), none(spark)).collect()}
    assert got["1"].split("\n")[-1].startswith("fim") and "dois" not in got["1"] and got["2"].split("\n")[-1].startswith("fim")


def test_short_sections_merge_within_their_path_only(spark):
    drafts = spark.createDataFrame(
        [(1, 1, "a", "T1", 1, 1, ["x"], "tiny"), (1, 2, "a", "T2", 2, 3, ["w"], "y" * 60), (1, 3, "b", "T3", 4, 4, [], "small"), (2, 1, "b", "T4", 1, 1, [], "other")],
        "doc_id long, position long, section_path string, section_title string, page_start int, page_end int, risk_codes array<string>, text string",
    )
    got = S.merge_short(drafts.repartition(3)).orderBy("doc_id", "position").collect()
    assert [(r.doc_id, r.position, r.section_title, r.page_start, r.page_end, r.risk_codes, r.text) for r in got] == [
        (1, 1, "T1", 1, 3, ["w", "x"], "tiny\n\n" + "y" * 60), (1, 3, "T3", 4, 4, [], "small"), (2, 1, "T4", 1, 1, [], "other"),
    ]


def test_documents_without_sections_are_cut_as_any_text(spark):
    paged = spark.createDataFrame([(1, 1, "1 Um\n" + "texto um " * 9), (2, 2, "more text of the second page"), (2, 1, "plain text " * 9)], "doc_id long, page_number int, text string")
    spans = spark.createDataFrame([(1, 1, None, None, 0, "1", "Um", None, "k", None)], RAW)
    got = {r.doc_id: r for r in S.chunk_sources(paged, S.normalized_spans(spans), none(spark)).collect()}
    assert got[1].section_path == "1" and got[2].section_path is None and got[2].text.startswith("plain text") and got[2].text.endswith("second page")


def test_places_slice_the_source(spark):
    text = "  1 Geral é\n\n\tANEXO IV - Lista\nTabela 2: Limites\nCONTROLE INTERNO\nCódigo: POP-01 \n1.1.1 Sem pai\r\nprosa comum de um texto, sem titulo"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = S.structure_hints(docs).orderBy("line_index").collect()
    assert [(r.kind, r.label, r.title, r.risk) for r in got] == [
        ("section", "1", "Geral é", ""), ("annex", "IV", "Lista", ""), ("table", "2", "Limites", ""), ("ambiguous_section", "CONTROLE INTERNO", "CONTROLE INTERNO", "ambiguous_section_heading"),
        ("form_field", "Código", "POP-01", ""), ("section", "1.1.1", "Sem pai", "section_hierarchy_gap"),
    ]
    for r in S.source_lines(docs).collect():
        assert text[r.char_start : r.char_end] == r.line if r.doc_id == 1 else r.line == ""


def test_ancestors(spark):
    labels = ["1", "1.1", "1.1.1", "1.2", "1.2.1.1", "2", "2.1.1", "Objetivo", "1.1", "3", "3.1", "3.1.1"]
    lines = spark.createDataFrame([(1, 1, k, x if x[0] == "O" else f"{x} titulo") for k, x in enumerate(labels)], LINED)
    got = [(r.label, r.gap) for r in S.headings(lines).orderBy("line_index").collect()]
    assert [x for x, gap in got if gap] == ["1.2.1.1", "2.1.1", "1.1"] and len(got) == 12
    empty = spark.createDataFrame([], LINED)
    assert S.section_spans(empty).count() == 0 and S.boilerplate_places(empty).select(F.count("*")).first()[0] == 0
