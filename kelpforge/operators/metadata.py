"""Metadata of controlled documents from file names, labels and headers: code, type, revision, status, owner, gaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import let
from ..sources.stored import dealt

# Fixed values (patterns, labels and aliases that results depend on).
DOCUMENT_CODE = r"(?i)\b((?:POP|IT|MAN|MANUAL|POL|FOR|FRM|REG|ESP|SPEC|FAQ)(?:[ .-][A-Z]{1,8}){0,3}[ .-]\d{1,4})\b"
PROTOCOL_CODE = r"(?i)\b([A-Z]{2,5}(?:\.[A-Z]{2,16})+(?:-[A-Z]{2,16})?\.\d{1,4})\b"
COMPACT_CODE = r"(?i)\b((?!REV\d{1,3}\b)[A-Z]{2,8}\d{2,4})\b"
REVISION = r"(?i)\b(?:rev(?:isao)?\.?|revisao|revision|versao(?:\s*n)?|version|r)\s*(?:n\.?)?\s*[:.\-]?\s*(\d{1,3}(?:\.\d{1,3})*)\b"
LABELED = r"^\s*([^:\n]{2,40})\s*:\s*(.+?)\s*$"
TYPES = {
    "POP": "POP", "IT": "IT", "FAQ": "FAQ", "PTC": "PTC", "MAN": "Manual", "MANUAL": "Manual", "POL": "Policy", "FOR": "Form", "FRM": "Form", "REG": "Record", "ESP": "Specification", "SPEC": "Specification",
}
STATUSES = {
    "vigencia": "vigent", "vigente": "vigent", "vigent": "vigent", "aprovado": "approved", "approved": "approved", "obsoleto": "obsolete", "obsolete": "obsolete", "rascunho": "draft", "draft": "draft",
}
PHRASES = {"procedimento operacional padrao": "POP", "instrucao de trabalho": "IT", "protocolo": "PTC"}
CODE_LABELS = ["codigo", "code", "document code", "documento", "numero", "number", "n"]
REVISION_LABELS = ["revisao", "revision", "rev", "versao", "versao n", "versao no", "version"]
STATUS_LABELS = ["status", "situacao"]
OWNER_LABELS = ["area dona", "owner area", "area", "departamento", "depto"]
TITLE_LABELS = ["titulo", "title"]
OTHER_LABELS = ["pagina", "pagina total", "data", "responsavel nome", "aprovacao nome"]
CONTENTS = ["sumario", "indice", "table of contents"]
NESTED_TYPES = ["POP", "IT", "MAN", "MANUAL", "POL", "PTC"]
DASHES = "‐‑‒–—−"
HEAD_CHARS, HEAD_LINES = 4000, 100

STACKED = CODE_LABELS + REVISION_LABELS + STATUS_LABELS
HEADERS = STACKED + OWNER_LABELS + TITLE_LABELS + OTHER_LABELS


def search_text(text: Column) -> Column:
    """Twice encoded letters repaired, dashes and accented letters plain, other letters beyond ASCII left out."""

    def again(t: Column) -> Column:
        twice = ~t.rlike(r"[^\x00-\xFF]") & t.rlike(r"[\xC2-\xF4][\x80-\xBF]")
        return F.when(twice, F.make_valid_utf8(F.encode(t, "ISO-8859-1").cast("string")))

    def plain(t: Column) -> Column:
        one = F.coalesce(let(again(t), lambda x: F.when(~x.contains("\ufffd"), x)), t)
        return F.regexp_replace(F.translate(one, DASHES + X.ACCENTED, "-" * len(DASHES) + X.PLAIN), r"[^\x00-\x7F]", "")

    return let(text, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), plain(t)).otherwise(t))


def label(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(search_text(text)), "[^a-z0-9 ]+", " "), r"\s+", " "))


def code_form(code: Column) -> Column:
    """Upper case without blanks around dashes and dots, and without such signs at the ends."""
    joined = F.regexp_replace(F.regexp_replace(F.upper(search_text(code)), r"\s*-\s*", "-"), r"\s*\.\s*", ".")
    return F.regexp_replace(F.regexp_replace(joined, r"[ \t]+", " "), r"^[ .:-]+|[ .:-]+$", "")


def revision_form(revision: Column) -> Column:
    return let(F.upper(F.trim(revision)), lambda upper: F.when(upper.rlike(r"^\d+$") & (F.length(upper) < 2), F.lpad(upper, 2, "0")).otherwise(upper))


def _found(text: Column, pattern: str) -> Column:
    return let(F.regexp_extract(text, pattern, 1), lambda x: F.nullif(x, F.lit("")))


def find_code(text: Column, compact: bool) -> Column:
    """The first code of a text, of the named kinds first."""
    kinds = [DOCUMENT_CODE, PROTOCOL_CODE, *([COMPACT_CODE] if compact else [])]
    return code_form(let(search_text(text), lambda plain: F.when(plain.rlike(r"\d"), F.coalesce(*[_found(plain, p) for p in kinds]))))


def code_prefix(code: Column) -> Column:
    return F.upper(F.element_at(F.split(code, "[- .]"), 1))


def nested_codes(text: Column) -> Column:
    """Whether a text names two or more different codes of kinds that can hold others."""
    found = lambda plain: F.concat(F.regexp_extract_all(plain, F.lit(DOCUMENT_CODE), 1), F.regexp_extract_all(plain, F.lit(PROTOCOL_CODE), 1))
    # the number of either kind of code stands behind one of these signs; most texts have none and are not searched further
    every = let(search_text(text), lambda plain: F.when(plain.rlike(r"[ .\-]\d"), found(plain)).when(plain.isNotNull(), F.array().cast("array<string>")))
    codes = F.array_distinct(F.transform(every, code_form))
    return F.size(F.filter(codes, lambda c: code_prefix(c).isin(NESTED_TYPES))) >= 2


def status_of(text: Column) -> Column:
    """The status whose marker, in the fixed order, stands in a text."""
    return let(F.lower(search_text(text)), lambda lower: F.coalesce(*[F.when(F.contains(lower, F.lit(marker)), F.lit(status)) for marker, status in STATUSES.items()]))


def _first(values: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.element_at(values, F.lit(name)) for name in names])


def metadata(docs: DataFrame) -> DataFrame:
    """``filename, text`` with document_code, document_type, title, revision, status, owner_area and gap_codes.

    A label's value is what follows its colon, the last one counts; a code, revision or status label that stands alone
    takes the next line that is no label. A code is looked for by label, near a label, in the file's name, and, unless the
    text names several codes, in its header. Null texts count as empty; rows are judged each on its own.
    """
    lines = F.slice(F.split(F.col("_text"), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]", -1), 1, HEAD_LINES)
    own = dealt(docs).withColumn("_text", F.coalesce("text", F.lit("")))
    read = own.withColumn("_lines", lines).withColumn("_labels", F.transform("_lines", label))
    parts = F.filter(
        F.transform(F.filter("_lines", lambda x: x.contains(":")), lambda x: F.struct(label(F.regexp_extract(x, LABELED, 1)).alias("k"), F.trim(F.regexp_extract(x, LABELED, 2)).alias("v"))), lambda x: (x["k"] != "") & (x["v"] != "")
    )
    pairs = let(parts, lambda found: F.transform(F.array_distinct(F.transform(found, lambda x: x["k"])), lambda k: F.struct(k, F.element_at(F.filter(found, lambda x: x["k"] == k), -1)["v"])))
    read = read.withColumn("_pairs", F.map_from_entries(pairs))

    def below(at: Column) -> Column:
        near = F.filter(F.transform(F.slice(F.arrays_zip(F.col("_lines").alias("l"), F.col("_labels").alias("n")), at + 2, F.lit(7)), lambda x: F.struct(F.trim(x["l"]).alias("l"), x["n"].alias("n"))), lambda x: (x["l"] != "") & ~x["n"].isin(HEADERS))
        return F.get(near, F.lit(0))["l"]

    alone = F.filter(F.transform("_labels", lambda n, k: F.struct(n.alias("k"), F.when(n.isin(STACKED), below(k)).alias("v"))), lambda x: x["v"].isNotNull())
    read = read.withColumn("_alone", alone)
    fresh = F.transform(F.filter(F.array_distinct(F.transform("_alone", lambda x: x["k"])), lambda k: ~F.map_contains_key("_pairs", k)), lambda k: F.struct(k, F.get(F.filter("_alone", lambda x: x["k"] == k), F.lit(0))["v"]))
    read = read.withColumn("_labeled", F.map_concat("_pairs", F.map_from_entries(fresh)))

    def of_labels(names: list[str], read_value: Callable[[Column], Column]) -> Column:
        each = F.transform(F.array(*[F.lit(x) for x in names]), lambda name: read_value(F.element_at("_labeled", name)))
        return F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0))

    labeled_code = of_labels(CODE_LABELS, lambda x: find_code(x, True))

    def window(at: Column) -> Column:
        taken = F.slice("_lines", at + 2, F.lit(11))
        stops = F.filter(F.sequence(F.lit(1), F.size(taken)), lambda k: F.get(F.slice("_labels", at + 2, F.lit(11)), k - 1).isin(CONTENTS))
        return F.array_join(F.slice(taken, 1, F.coalesce(F.get(stops, F.lit(0)) - 1, F.size(taken))), "\n")

    spots = F.filter(F.sequence(F.lit(0), F.size("_labels") - 1), lambda k: F.get("_labels", k).isin(CODE_LABELS) & (k < F.size("_labels") - 1))
    near_code = F.get(F.filter(F.transform(spots, lambda k: find_code(window(k), True)), lambda c: c.isNotNull()), F.lit(0))
    stop = F.coalesce(F.get(F.filter(F.sequence(F.lit(0), F.size("_labels") - 1), lambda k: F.get("_labels", k).isin(CONTENTS)), F.lit(0)), F.size("_labels"))
    numbered = F.slice(F.arrays_zip(F.col("_lines").alias("l"), F.col("_labels").alias("n")), F.lit(1), stop)
    header = F.slice(F.transform(F.filter(numbered, lambda x: (F.trim(x["l"]) != "") & ~x["n"].rlike(r"^\d+$")), lambda x: x["l"]), 1, 40)
    haystack = search_text(F.concat(F.coalesce("filename", F.lit("")), F.lit("\n"), F.substring("_text", 1, HEAD_CHARS)))
    read = read.withColumns({"_nested": nested_codes(F.col("_text")), "_named": labeled_code, "_near": near_code, "_file": find_code(F.col("filename"), True), "_header": find_code(F.array_join(header, "\n"), False), "_hay": haystack})
    code = F.coalesce("_named", "_near", "_file", F.when(~F.col("_nested"), F.col("_header")))
    label_revision = of_labels(REVISION_LABELS, lambda x: _found(x, r"(\d{1,3}(?:\.\d{1,3})*)"))
    read = read.withColumns({"document_code": code, "revision": revision_form(F.coalesce(label_revision, _found(search_text(F.col("_hay")), REVISION)))})
    by_code = let(code_prefix(F.col("document_code")), lambda prefix: F.coalesce(F.element_at(X.named(TYPES), prefix), F.when(~prefix.rlike(r"\d"), prefix)))
    by_text = let(F.lower(search_text(F.col("_hay"))), lambda plain: F.coalesce(*[F.when(F.contains(plain, F.lit(phrase)), F.lit(kind)) for phrase, kind in PHRASES.items()]))
    gaps = F.array_compact(F.array(F.when(F.col("document_code").isNull(), "missing_document_code"), F.when(F.col("document_code").isNull() & F.col("_nested"), "ambiguous_nested_document_codes"), F.when(F.col("revision").isNull(), "missing_revision")))
    return read.select(
        *docs.columns, "document_code", F.coalesce(by_code, by_text).alias("document_type"), _first(F.col("_labeled"), TITLE_LABELS).alias("title"), "revision",
        F.coalesce(status_of(_first(F.col("_labeled"), STATUS_LABELS)), status_of(F.col("_hay"))).alias("status"), _first(F.col("_labeled"), OWNER_LABELS).alias("owner_area"), gaps.alias("gap_codes"),
    )
