"""From texts to pages, lines, sections and chunks; profiles, gates and candidates on the way.

All of it partitions by document: a document's lines are ordered within the document, and no window or group spans a
source or the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Fixed values.
MAX_CHARS = 500_000
MIN_CHARS = 100
WINDOW_CHARS, WINDOW_STEP = 3200, 2800
MAX_CHUNK_TOKENS = 800
MIN_CHUNK_CHARS = 50
SHEET_ROWS = 15
MAX_EMPTY_SHARE = 0.3
CAPTION = r"(?i)\b(?:Figura\s+\d+|Imagem(?:\s+\d+)?|Fluxograma|Anexo(?:\s+(?:[IVXLCDM]+|\d+))?)\b\s*[-–:]\s*\S"
TEXT_LAYERS = ["digital_text", "mixed", "scanned_image", "empty"]
COMPLEXITIES = ["low", "medium", "high"]
SECTION = r"^(\d+(?:\.\d+)*)(?:[\.)])?\s+(\S.+?)$"
QMS_HEADINGS = ["objetivo", "aplicacao", "responsabilidades", "procedimento", "registros", "anexos"]
NORMATIVE = r"(?i)\b(deve|devem|obrigatorio|obrigatoria|proibido|proibida|necessario|necessaria)\b"
FORM_ID = r"(?i)\b((?:FOR|FR)-[A-Z]{2,}-\d{2,})\b"
ANNEX = r"(?i)\bAnexo\s+([IVXLCDM]+|\d+)\s*[-–:]?\s*(.+)?$"
RECORD = r"(?i)\b(Registro|Formulario|Formulário|Lista de verificacao|Lista de verificação|Anexo)\b"
EQUIPMENT = r"(?iu)\b(?:Equipamento|Instrumento|Maquina|Máquina)\s*:\s*(.+)$"
RESPONSIBILITY = r"(?iu)^(?:O|A|Os|As)\s+([A-ZÁÀÂÃÉÊÍÓÔÕÚÇ][A-Za-zÁÀÂÃÉÊÍÓÔÕÚÇáàâãéêíóôõúç ]{2,60}?)\s+(?:deve|devem|é responsável por|e responsavel por)\s+(.+)$"
STEP = r"^\s*(\d+(?:\.\d+)*)(?:[\.)])\s+(.+?)\s*$"
ROLES = ["gerente", "supervisor", "coordenador", "responsavel", "operador", "analista", "equipe", "setor"]
TOC_LEADER = r"\.{3,}\s*\d+\s*$"
TOC_ENTRY = r"^\s*\d+(?:\.\d+)*\s+\S.+$"
TOC_TITLES = ["sumario", "indice", "table of contents"]
CONFIDENCE = {"requirement": 0.82, "responsibility": 0.78, "annex": 0.7, "form": 0.8, "record": 0.76, "equipment": 0.72, "step": 0.74}


def windows(docs: DataFrame, size: int = WINDOW_CHARS, step: int = WINDOW_STEP) -> DataFrame:
    """Overlapping character windows of each text, each with its sha256 and token estimate.

    The last window ends with the text; an empty or null text has none.
    """
    n = F.length("text")
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    cut = docs.where(n > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    piece = F.substr("text", F.col("chunk_index") * step + 1, F.lit(size))
    return cut.select("doc_id", "chunk_index", piece.alias("chunk")).select(
        "doc_id", "chunk_index", F.length("chunk").cast("long").alias("char_count"), X.chunk_tokens(F.col("chunk")).alias("token_estimate"), F.sha2("chunk", 256).alias("chunk_hash")
    )


def pages(docs: DataFrame, lines_each: int = 10) -> DataFrame:
    """``doc_id, page_number, text``: texts dealt into pages of so many lines, numbered from 1."""
    lines = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    last = ((F.size("lines") - 1) / lines_each).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k + 1).alias("page_number"), F.array_join(F.slice("lines", k * lines_each + 1, F.lit(lines_each)), "\n").alias("text")))
    return lines.select("doc_id", F.inline(cut))  # no page carries the lines of its whole document


def lines(paged: DataFrame) -> DataFrame:
    """``doc_id, page_number, line_index, line``: stripped lines, empty ones left out."""
    exploded = paged.select("doc_id", "page_number", F.posexplode(F.split("text", "\n", -1)).alias("line_index", "raw"))
    return exploded.select("doc_id", "page_number", "line_index", X.trimmed(F.col("raw")).alias("line")).where("line <> ''")


def quality_gate(paged: DataFrame) -> DataFrame:
    """One verdict for each document from its pages: too short, all empty, or passed with warnings."""
    empty = F.length(X.trimmed(F.col("text"))) == 0
    summed = paged.groupBy("doc_id").agg(F.sum(F.length("text")).alias("total_chars"), F.count("*").alias("total_pages"), F.count_if(empty).alias("empty_pages"))
    reason = F.when(F.col("total_chars") < MIN_CHARS, "too_short").when(F.col("empty_pages") == F.col("total_pages"), "all_pages_empty")
    warnings = F.array_compact(
        F.array(F.when(F.col("total_chars") > MAX_CHARS, "content_very_large"), F.when(F.col("empty_pages") / F.col("total_pages") > MAX_EMPTY_SHARE, "high_empty_page_ratio"))
    )
    return summed.withColumn("rejection_reason", reason).select(
        "doc_id", "total_chars", "total_pages", "empty_pages", F.col("rejection_reason").isNull().alias("passed"), "rejection_reason",
        F.when(F.col("rejection_reason").isNull(), F.array_join(warnings, ",")).otherwise("").alias("warnings"),
    )


def within_budget(paged: DataFrame, budget: int = MAX_CHARS) -> DataFrame:
    """Pages cut to a document's character budget in order, and whether a page was cut."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(budget) - before, F.lit(0)).cast("int")
    return paged.select("doc_id", "page_number", F.length("text").alias("n"), left.alias("left")).select(
        "doc_id", "page_number", F.least("n", "left").cast("long").alias("kept_chars"), ((F.col("n") > F.col("left")) | (F.col("left") == 0)).alias("truncated")
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, content_hash, first_id, duplicate``: the smallest id of each text and who repeats it.

    Hashes are grouped with map-side minima; the join back splits where one text is very frequent.
    """
    hashed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"))
    return hashed.join(first, "content_hash").select("doc_id", "content_hash", "first_id", (F.col("doc_id") != F.col("first_id")).alias("duplicate"))


def boilerplate(paged: DataFrame) -> DataFrame:
    """``doc_id, edge, line_key, n_pages``: first or last lines that recur on half of a document's pages, two at least."""
    edges = lines(paged).groupBy("doc_id", "page_number").agg(F.min_by("line", "line_index").alias("first"), F.max_by("line", "line_index").alias("last"))
    total = paged.groupBy("doc_id").agg(F.count("*").alias("pages")).where("pages >= 2")
    keyed = edges.select("doc_id", F.explode(F.map_from_arrays(F.array(F.lit("first"), F.lit("last")), F.array(X.boilerplate_key(F.col("first")), X.boilerplate_key(F.col("last"))))).alias("edge", "line_key"))
    counted = keyed.groupBy("doc_id", "edge", "line_key").agg(F.count("*").alias("n_pages"))
    return counted.join(total, "doc_id").where(F.col("n_pages") >= F.greatest(F.lit(2), F.floor((F.col("pages") + 1) / 2))).select("doc_id", "edge", "line_key", "n_pages")


def sections(docs: DataFrame) -> DataFrame:
    """``doc_id, section_index, heading, body``: lines below each heading; those before any have none.

    Headings begin with ``#`` or are short and in capitals; a heading with nothing below gives no section.
    """
    split = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("k", "raw")).select("doc_id", "k", X.trimmed(F.col("raw")).alias("line"))
    flagged = split.withColumn("is_heading", (F.col("line") != "") & X.is_heading(F.col("line")))
    order = Window.partitionBy("doc_id").orderBy("k")
    numbered = flagged.withColumn("section_index", F.sum(F.col("is_heading").cast("int")).over(order))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("k", "line")))), lambda x: x["line"]), "\n")
    heading = F.max(F.when(F.col("is_heading"), F.trim(F.regexp_replace("line", "^#+", ""))))
    grouped = numbered.groupBy("doc_id", "section_index").agg(heading.alias("heading"), X.trimmed(body).alias("body"))
    return grouped.where("body <> ''").select("doc_id", F.col("section_index").cast("long").alias("section_index"), "heading", "body")


def blocks(sectioned: DataFrame) -> DataFrame:
    """``doc_id, section_index, block_index, block``: short bodies whole, else their paragraphs, else windows of those."""
    body = F.col("body")
    paragraphs = F.when(X.chunk_tokens(body) <= MAX_CHUNK_TOKENS, F.array(body)).otherwise(F.filter(F.split(body, "\n\n"), lambda p: p.rlike(r"\S")))

    def cut(p: Column) -> Column:
        last = F.when(F.length(p) <= WINDOW_CHARS, 0).otherwise(F.ceil((F.length(p) - WINDOW_CHARS) / WINDOW_STEP)).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), last), lambda k: X.trimmed(F.substr(p, k * WINDOW_STEP + 1, F.lit(WINDOW_CHARS))))
        return F.when(X.chunk_tokens(p) <= MAX_CHUNK_TOKENS, F.array(X.trimmed(p))).otherwise(F.filter(pieces, lambda x: x != ""))

    return sectioned.select("doc_id", "section_index", F.posexplode(F.flatten(F.transform(paragraphs, cut))).alias("block_index", "block"))


def sheet_blocks(rows: DataFrame, size: int = SHEET_ROWS) -> DataFrame:
    """Table rows ``filename, sheet, row_index, headers, cells`` in blocks of ``size``, each as one text of piped lines.

    Blocks are counted from the first row of each sheet of each file, whatever its number.
    """
    line = lambda a: F.concat(F.lit("| "), F.array_join(a, " | "), F.lit(" |"))
    place = F.row_number().over(Window.partitionBy("filename", "sheet").orderBy("row_index")) - 1
    placed = rows.select("filename", "sheet", "row_index", line(F.col("headers")).alias("head"), line(F.col("cells")).alias("l"), F.floor(place / size).alias("block"))
    blocked = placed.groupBy("filename", "sheet", "block", "head").agg(F.min("row_index").alias("row_start"), F.max("row_index").alias("row_end"), F.array_sort(F.collect_list(F.struct("row_index", "l"))).alias("lines"))
    lines = F.transform("lines", lambda x: x["l"])
    return blocked.select("filename", "sheet", "row_start", "row_end", F.array_join(F.concat(F.array(F.concat(F.lit("Tabela: "), F.col("sheet")), F.col("head")), lines), "\n").alias("text"))


def is_table_line(line: Column) -> Column:
    """Two pipes, or three columns two blanks apart; a line without two blanks is not cut into columns."""
    columns = F.size(F.filter(F.split(F.trim(line), r"\s{2,}"), lambda x: x != ""))
    return (F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 2) | (line.rlike(r"\s\s") & (columns >= 3))


def page_profiles(paged: DataFrame, images: Column | None = None) -> DataFrame:
    """Measures and risks of each page from its text and the number of images on it."""
    n_images = images if images is not None else F.lit(0)
    filled = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"\S"))
    base = paged.select("doc_id", "page_number", "text", F.length("text").cast("long").alias("text_chars"), filled.alias("filled"), n_images.cast("long").alias("image_count"))
    measured = base.select(
        "doc_id", "page_number", "text", "text_chars", F.size("filled").cast("long").alias("line_count"), "image_count",
        F.size(F.filter("filled", is_table_line)).cast("long").alias("table_candidates"),
    )
    chars, count, tables = F.col("text_chars"), F.col("image_count"), F.col("table_candidates")
    layer = F.when((chars > 0) & (count == 0), "digital_text").when((chars > 0) & (count > 0), "mixed").when(count > 0, "scanned_image").otherwise("empty")
    layout = F.when((count >= 3) | (tables >= 2), "high").when((count > 0) | (tables > 0) | (F.col("line_count") >= 8), "medium").otherwise("low")
    marked = measured.withColumn("text_layer_type", layer).withColumn("layout_complexity", layout)
    risks = F.array_compact(
        F.array(
            F.when((chars == 0) & (count == 0), "empty_page"),
            F.when((chars == 0) & (count > 0), "ocr_required"),
            F.when(F.col("layout_complexity") == "high", "high_layout_complexity"),
            F.when(tables > 0, "table_candidates_present"),
            F.when((chars < 200) & (count > 0) & (chars > 0), "sparse_text_with_images"),
            F.when((chars < 200) & (count > 0) & ~F.col("text").rlike(CAPTION), "visual_content_without_caption"),
        )
    )
    return marked.withColumn("risk_codes", F.array_join(risks, ",")).drop("text")


def profile_summary(profiles: DataFrame) -> DataFrame:
    """Document-level counts over its page profiles."""
    kinds = [F.count_if(F.col("text_layer_type") == k).alias(f"layer_{k}") for k in TEXT_LAYERS] + [F.count_if(F.col("layout_complexity") == k).alias(f"complexity_{k}") for k in COMPLEXITIES]
    return profiles.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("text_chars").alias("chars"), F.sum("table_candidates").alias("tables"), F.count_if(F.col("risk_codes") != "").alias("risky_pages"), *kinds)


def table_candidates(docs: DataFrame, preview: int = 5) -> DataFrame:
    """One table candidate for each document with table lines: their number and the first few."""
    found = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"\S") & is_table_line(x))
    held = docs.select("doc_id", F.transform(found, lambda x: F.trim(x)).alias("rows")).where(F.size("rows") > 0)
    return held.select("doc_id", F.size("rows").cast("long").alias("row_count"), F.array_join(F.slice("rows", 1, preview), "\n").alias("preview"))


def candidates(lined: DataFrame) -> DataFrame:
    """Typed candidates of each line: requirements, responsibilities, references, equipment and numbered steps.

    ``doc_id, section, line_index, line`` in. Lines of a table of contents give none. Steps are numbered in their section.
    """
    line = F.col("line")
    toc = line.rlike(TOC_LEADER) | X.fold(F.trim(line)).isin(TOC_TITLES)
    in_toc = F.coalesce(X.fold(F.col("section")).isin(TOC_TITLES), F.lit(False))
    role = F.trim(F.regexp_extract(line, RESPONSIBILITY, 1))
    explicit = X.fold(role).rlike(f"^({'|'.join(ROLES)})")
    annex, form = line.rlike(ANNEX), line.rlike(FORM_ID)
    number = F.concat(F.lit("ANEXO "), F.upper(F.regexp_extract(line, ANNEX, 1)))
    form_id = F.upper(F.regexp_extract(line, FORM_ID, 1))
    one = lambda kind, name, detail, when: F.when(when, F.struct(F.lit(kind).alias("kind"), detail.alias("detail"), F.lit(CONFIDENCE[name]).alias("confidence")))
    found = F.array_compact(
        F.array(
            one("requirement", "requirement", F.when(line.rlike(r"(?i)\bproibid[oa]\b"), "prohibited").otherwise("mandatory"), line.rlike(NORMATIVE) & ~(in_toc & line.rlike(TOC_ENTRY))),
            one("responsibility", "responsibility", role, (role != "") & explicit),
            one("record_reference", "annex", number, annex & ~in_toc),
            one("form_reference", "form", form_id, ~annex & form & ~in_toc),
            one("record_reference", "record", form_id, ~annex & form & line.rlike(RECORD) & ~in_toc),
            one("equipment_reference", "equipment", F.trim(F.regexp_extract(line, EQUIPMENT, 1)), line.rlike(EQUIPMENT) & ~in_toc),
            one("procedure_step", "step", F.regexp_extract(line, STEP, 1), line.rlike(STEP) & ~in_toc),
        )
    )
    rows = lined.where(~toc).select("doc_id", "section", "line_index", F.explode(found).alias("c")).select("doc_id", "section", "line_index", "c.kind", "c.detail", "c.confidence")
    order = F.row_number().over(Window.partitionBy("doc_id", "section", "kind").orderBy("line_index"))
    return rows.withColumn("step_order", F.when(F.col("kind") == "procedure_step", order))
