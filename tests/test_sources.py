import io
import zipfile

from kelpforge.plans.bundle import readiness, write_bundle
from kelpforge.sources import files as S

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    p = lambda style, t: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = p("Heading1", "Title") + p("Heading2", "Part") + p("Normal", "Text é") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl>"
    return archive({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def xlsx(rows=None, sheets=1):
    rows = rows or '<row r="1"><c r="A1"/></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>c</t></is></c></row><row r="5"><c r="A5"><v>7</v></c></row>'
    return archive({
        "xl/workbook.xml": f'<workbook {X} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{'<sheet name="S" r:id="r1"/>' * sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {X}><si><t>a</t></si></sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet {X}><sheetData>{rows}</sheetData></worksheet>",
    })


def test_formats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, data: (tmp_path / "in" / name).write_bytes(data)
    put("a.txt", "﻿ olá \n".encode())
    put("b.txt", "caf\xe9".encode("latin-1"))
    put("c.csv", b"x;y\n1;2\n;\n3;\n")
    put("d.docx", docx())
    put("e.xlsx", xlsx())
    put("f.zip", archive({"x/y.txt": "1", "../evil": "2"}))
    put("g.exe", b"MZ")
    put("h.docx", b"not a zip")
    put("i.csv", b"only;a;header\n")
    found = S.files(spark, str(tmp_path / "in"))
    of = lambda ext: found.where(f"extension = '{ext}'")
    assert sorted(r.text for r in S.text_pages(of("txt")).collect()) == ["café", "olá"]
    rows = {(r.row_index, tuple(r.cells)) for r in S.csv_rows(of("csv").where("name = 'c.csv'")).collect()}
    assert rows == {(2, ("1", "2")), (3, ("", "")), (4, ("3", ""))}
    assert [r.error for r in S.csv_rows(of("csv").where("name = 'i.csv'")).collect()] == ["empty_content"]
    assert [(r.text, r.error) for r in S.docx_pages(of("docx")).orderBy("path").collect()] == [("## Title\n\n### Part\n\nText é\n\n| a | b |", None), (None, "parse_failed")]
    assert [(r.sheet, r.row_index, r.headers, r.cells) for r in S.xlsx_rows(of("xlsx")).collect()] == [("S", 5, ["a", "", "c"], ["7", "", ""])]
    assert {(r.entry, r.error, r.data is None) for r in S.zip_entries(of("zip")).collect()} == {("x/y.txt", None, False), ("../evil", "unsafe_path", True)}
    assert {r.name: r.rejection for r in S.verdict(found).collect() if r.rejection} == {"g.exe": "extension_blocked", "h.docx": "magic_mismatch"}


def test_markdown(spark):
    text = "---\nkey: v\n---\nintro\n# One\na\n\nb\n## Two\n# Three\nc\n"
    got = S.markdown_sections(spark.createDataFrame([("p", text), ("q", "none")], "path string, text string")).collect()
    assert [(r.start_line, r.heading, r.body) for r in got] == [(5, "One", "a\n\nb"), (9, "Two", ""), (10, "Three", "c")]


def test_bundle(tmp_path):
    assert readiness(["b", "b"], ["w"]) == {"status": "blocked", "blockers": ["b"], "warnings": ["w"], "score": 70}
    path = tmp_path / "x.json"
    assert write_bundle('{"b": 1, "a": "é"}', path, check=True) and not path.exists()
    assert write_bundle('{"b": 1, "a": "é"}', path) and not write_bundle('{"a": "é", "b": 1}', path)


def test_broken_workbooks():
    bad = ['<row r="x"><c r="A1"/></row>', '<row r="1"><c r="A1" t="s"><v>9</v></c></row>', '<row r="1"><c r="ZZZZZZ1"><v>1</v></c></row>']
    assert all(S._xlsx_tables(xlsx(rows)) == [(None, None, None, None, "parse_failed")] for rows in bad)
    many = S._xlsx_tables(xlsx(sheets=S.MAX_SHEETS + 1))
    assert many[0] == (None, None, None, None, "sheets_truncated") and len(many) == 1 + S.MAX_SHEETS
