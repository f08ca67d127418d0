"""File sources: texts, tables, Word and Excel documents, Markdown and archives as rows.

Files come through Spark's own ``binaryFile`` reader, one row each, so that any store Spark reads will do; each format
is one pass over those rows. A file that cannot be read is a row with an error, never an exception. PDF needs a
library that is not here: such files are marked ``unsupported_format``.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed

# Fixed values.
MAX_FILE_BYTES = 50 << 20
MAX_TEXT_BYTES = 1 << 20
MAX_ROWS = 10_000
MAX_SHEETS = 20
MAX_COLUMNS = 16_384
MAX_ENTRIES, MAX_ARCHIVE_BYTES = 1000, 100 << 20
MAX_OFFICE_ENTRIES, MAX_RATIO = 5000, 100
KINDS = {"txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "docx": "docx", "xlsx": "xlsx", "pdf": "application/pdf", "zip": "application/zip"}
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, name, extension, length, content`` of the files below a folder; Spark's reader passes empty files over."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return found.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), "length", "content")


def decoded(content: Column) -> Column:
    """UTF-8 without its mark, else Latin-1."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def verdict(found: DataFrame) -> DataFrame:
    """The first thing wrong with each file: empty, too large, extension, signature, or an unsafe office archive."""
    head = F.substring("content", 1, 4)
    zipped = F.col("extension").isin("docx", "xlsx", "zip")
    wrong = (
        F.when(F.col("length") == 0, "empty_file")
        .when(F.col("length") > MAX_FILE_BYTES, "file_too_large")
        .when(~F.col("extension").isin(*KINDS), "extension_blocked")
        .when((F.col("extension") == "pdf") & (head != F.lit(b"%PDF")), "magic_mismatch")
        .when(zipped & (head != F.lit(b"PK\x03\x04")), "magic_mismatch")
    )
    inspected = F.pandas_udf(lambda contents: contents.map(_office_fault), "string")
    fault = F.when(F.col("extension").isin("docx", "xlsx"), inspected("content"))
    return found.withColumn("rejection", F.coalesce(wrong, fault))


def _office_fault(data: bytes) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            entries = archive.infolist()
    except zipfile.BadZipFile:
        return "bad_archive"
    if len(entries) > MAX_OFFICE_ENTRIES or any(x.filename.startswith("/") or ".." in x.filename.split("/") for x in entries):
        return "unsafe_archive"
    if any("vbaproject" in x.filename.lower() for x in entries):
        return "macro"
    size = sum(x.file_size for x in entries)
    return "zip_bomb" if size > 10 << 20 and size > MAX_RATIO * max(len(data), 1) else None


def text_pages(found: DataFrame) -> DataFrame:
    """``path, page_number, text, error``: each text file as one page, of its first MiB."""
    text = trimmed(decoded(F.substring("content", 1, MAX_TEXT_BYTES)))
    return found.select("path", F.lit(1).alias("page_number"), text.alias("text"), F.when(text == "", "empty_content").alias("error"))


def normalized_path(path: Column) -> Column:
    """Slashes forward; null for absolute paths, drive letters, empty parts and parents."""
    clean = F.regexp_replace(path, r"\\", "/")
    return F.when(~clean.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.?(/|$)|//|^$"), clean)


def _rows(found: DataFrame, read: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    names = ["path", *[x.split()[0] for x in schema.split(", ")[1:]]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([(path, *row) for row in read(data)], columns=names)

    return found.select("path", "content").mapInPandas(run, schema)


TABLE = "path string, sheet string, row_index int, headers array<string>, cells array<string>, error string"


def _table(name: str, rows: list[tuple[int, list[str]]]) -> list[tuple]:
    """The first row that holds anything names the columns; shorter rows are filled up."""
    filled = [k for k, (_, cells) in enumerate(rows) if any(cells)]
    if not filled:
        return []
    headers = rows[filled[0]][1]
    return [(name, at, headers, (cells + [""] * len(headers))[: len(headers)], None) for at, cells in rows[filled[0] + 1 :]]


def _csv_table(data: bytes) -> list[tuple]:
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    try:
        dialect = csv.Sniffer().sniff(text[:2048])
    except csv.Error:
        dialect = csv.excel
    rows = list(csv.reader(io.StringIO(text, newline=""), dialect))
    if len(rows) <= 1:
        return [("sheet1", None, None, None, "empty_content")]
    if len(rows) - 1 > MAX_ROWS:
        return [("sheet1", None, None, None, "rows_exceeded")]
    return _table("sheet1", [(k + 1, [x.strip() for x in row]) for k, row in enumerate(rows)])


def csv_rows(found: DataFrame) -> DataFrame:
    """``path, sheet, row_index, headers, cells, error`` of CSV files of any dialect; rows are numbered as in the file."""
    return _rows(found, _csv_table, TABLE)


def _xlsx_tables(data: bytes) -> list[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            names = set(archive.namelist())
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = ["".join(t.text or "" for t in x.iter(f"{_SHEET}t")) for x in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))]
            links = {x.get("Id"): x.get("Target", "") for x in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
            sheets = list(ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"))
            out: list[tuple] = [(None, None, None, None, "sheets_truncated")] if len(sheets) > MAX_SHEETS else []
            for sheet in sheets[:MAX_SHEETS]:
                target = links[sheet.get(f"{_REL}id")].lstrip("/")
                root = ElementTree.fromstring(archive.read(target if target.startswith("xl/") else f"xl/{target}"))
                rows = [(int(row.get("r", k + 1)), _xlsx_cells(row, shared)) for k, row in enumerate(root.iter(f"{_SHEET}row"))]
                if len(rows) - 1 > MAX_ROWS:
                    return [(sheet.get("name"), None, None, None, "rows_exceeded")]
                out += _table(sheet.get("name", ""), rows)
            return out
    except (KeyError, IndexError, ValueError, zipfile.BadZipFile, ElementTree.ParseError):  # bad row numbers, columns and shared texts too
        return [(None, None, None, None, "parse_failed")]


def _xlsx_cells(row, shared: list[str]) -> list[str]:
    cells: dict[int, str] = {}
    for k, cell in enumerate(row.iter(f"{_SHEET}c")):
        letters = re.match("[A-Z]*", cell.get("r", "")).group()
        at = k
        if letters:
            at = 0
            for c in letters:
                at = 26 * at + ord(c) - 64
            at -= 1
        if at >= MAX_COLUMNS:
            raise ValueError("a column beyond the last one")
        value = cell.findtext(f"{_SHEET}v") or ""
        if cell.get("t") == "s" and value:
            value = shared[int(value)]
        elif cell.get("t") == "inlineStr":
            value = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
        cells[at] = value.strip()
    return [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]


def xlsx_rows(found: DataFrame) -> DataFrame:
    """``path, sheet, row_index, headers, cells, error`` of Excel files, values only."""
    return _rows(found, _xlsx_tables, TABLE)


def _docx_page(data: bytes) -> list[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_WORD}body")
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        return [(None, None, "parse_failed")]
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD}t")).strip()
    blocks = []
    for p in body.findall(f"{_WORD}p"):
        style = p.find(f"{_WORD}pPr/{_WORD}pStyle")
        name = (style.get(f"{_WORD}val", "") if style is not None else "").lower().replace(" ", "")
        if text(p):
            blocks.append(("## " if name == "heading1" else "### " if name.startswith("heading") else "") + text(p))
    for table in body.findall(f"{_WORD}tbl"):
        blocks.append("\n".join("| " + " | ".join(text(c) for c in row.findall(f"{_WORD}tc")) + " |" for row in table.findall(f"{_WORD}tr")))
    whole = "\n\n".join(blocks)
    return [(1, whole, None if whole else "empty_content")]


def docx_pages(found: DataFrame) -> DataFrame:
    """``path, page_number, text, error`` of Word files: paragraphs, headings marked, then tables as piped lines."""
    return _rows(found, _docx_page, "path string, page_number int, text string, error string")


def _entries(data: bytes) -> list[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            entries = [x for x in archive.infolist() if not x.is_dir()]
            if len(entries) > MAX_ENTRIES or sum(x.file_size for x in entries) > MAX_ARCHIVE_BYTES:
                return [(None, None, "archive_too_large")]
            return [(x.filename, archive.read(x), None) for x in entries]
    except zipfile.BadZipFile:
        return [(None, None, "bad_archive")]


def zip_entries(found: DataFrame) -> DataFrame:
    """``path, entry, data, error`` of archives; entries with unsafe paths carry an error and no data."""
    rows = _rows(found, _entries, "path string, entry string, data binary, error string")
    safe = normalized_path(F.col("entry"))
    error = F.coalesce("error", F.when(F.col("entry").isNotNull() & safe.isNull(), "unsafe_path"))
    return rows.select("path", F.coalesce(safe, "entry").alias("entry"), F.when(error.isNull(), F.col("data")).alias("data"), error.alias("error"))


def markdown_sections(texts: DataFrame) -> DataFrame:
    """``path, start_line, heading, body`` of Markdown ``path, text``: one row a heading, up to the next of any level."""
    plain = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"(?s)^---\n.*?\n---\n", "")
    shift = F.size(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")) - F.size(F.split(plain, "\n"))
    lines = F.transform(F.split(plain, "\n"), lambda line, k: F.struct(k.alias("k"), line.alias("line")))
    marked = texts.select("path", shift.alias("shift"), lines.alias("lines")).withColumn("heads", F.filter("lines", lambda x: x["line"].rlike(r"^#+ ")))
    parts = F.transform(
        "heads",
        lambda h, j: F.struct(
            (h["k"] + 1 + F.col("shift")).alias("start_line"),
            F.trim(F.regexp_replace(h["line"], "^#+ ", "")).alias("heading"),
            F.array_join(F.transform(F.slice("lines", h["k"] + 2, F.coalesce(F.get("heads", j + 1)["k"], F.size("lines")) - h["k"] - 1), lambda x: x["line"]), "\n").alias("body"),
        ),
    )
    return marked.select("path", F.inline(parts)).withColumn("body", trimmed(F.col("body")))
