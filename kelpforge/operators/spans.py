"""Lines with their places in the source text, the section spans they open, and the chunks between those.

Lines meet their section in one order of document, page and line: a running value carries the last opened span, so that a
section may go on over pages and stop in the middle of one. Nothing gathers a document; only a chunk is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.stored import stored
from . import documents as D

# Fixed values.
ANNEX_HEADING = r"^(?iu)ANEXO\s+([IVXLCDM]+|\d+)\s*[-–:]?\s*(.*)$"
TABLE_HEADING = r"^(?iu)Tabela\s+(\d+)\s*[-–:]?\s*(.*)$"
FORM_FIELD = r"^([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9 /_-]{2,40}?)\s*:\s*(.+)$"
AMBIGUOUS_CHARS, AMBIGUOUS_WORDS = 60, 4
ANNEX_KIND, QMS_KIND, NUMBERED_KIND = "annex_section", "qms_section", "numbered_section"


def source_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_index, line, char_start, char_end``: the stripped lines of each text and where they stand in it.

    ``substr(text, char_start + 1, char_end - char_start)`` is the line. The offset of a line is the sum of the lengths of
    those before it, with their line ends. Lines of white space have no width; a null text has no lines.
    """
    cut = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_index", "raw"))
    before = Window.partitionBy("doc_id").orderBy("line_index").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("offset", F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)))
    line = X.trimmed(F.col("raw"))
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))
    start = F.col("offset") + F.when(line == "", 0).otherwise(lead)
    return placed.select("doc_id", "line_index", line.alias("line"), start.alias("char_start"), (start + F.length(line)).alias("char_end"))


def qms_key(line: Column) -> Column:
    """A heading's name without accents, case and the signs around it."""
    return F.regexp_replace(F.regexp_replace(X.fold_value(line), r"^[ :.\-]+|[ :.\-]+$", ""), r"\s+", " ")


def headings(lined: DataFrame) -> DataFrame:
    """``lined`` (``doc_id, page_number, line_index, line``) cut to its section headings, with ``label, title, level, path, gap``.

    A numbered heading lies below those of lower levels since the last fixed heading. A level's ancestor is there if the
    latest heading up to that level has just that level; where one is missing the path is the label alone. Headings are
    found in one pass over the lines and stored, since ancestors are looked for among them.
    """
    order = Window.partitionBy("doc_id").orderBy("page_number", "line_index")
    number = F.when(F.col("line").rlike(r"^\d"), F.nullif(F.regexp_extract("line", D.SECTION, 1), F.lit("")))
    key = qms_key(F.col("line"))
    label = F.coalesce(number, F.when(key.isin(D.QMS_HEADINGS), key))
    level = F.when(F.col("label").rlike(r"^\d"), F.size(F.split("label", r"\."))).otherwise(0)
    found = stored(lined.withColumn("label", label).where("label IS NOT NULL").withColumn("level", level), "headings")
    epoch = F.sum((F.col("level") == 0).cast("int")).over(order)
    named = found.withColumns({"epoch": epoch, "title": F.when(F.col("level") > 0, X.trimmed(F.regexp_extract("line", D.SECTION, 2))).otherwise(F.col("line"))})
    deep = named.where("level > 1")  # only they can lack an ancestor; every heading may be one, of its own level or any below
    deepest = deep.groupBy("doc_id", "epoch").agg(F.max("level").alias("deepest"))
    each = named.where("level > 0").join(deepest, ["doc_id", "epoch"]).select("doc_id", "epoch", "page_number", "line_index", "level", F.explode(F.sequence(F.lit(1), F.col("deepest") - 1)).alias("up_to"))
    latest = F.last(F.when(F.col("level") <= F.col("up_to"), F.col("level")), ignorenulls=True)
    above = Window.partitionBy("doc_id", "epoch", "up_to").orderBy("page_number", "line_index").rowsBetween(Window.unboundedPreceding, -1)
    missing = each.withColumn("latest", latest.over(above)).where("up_to < level AND (latest IS NULL OR latest <> up_to)").select("doc_id", "page_number", "line_index").distinct()
    joined = named.join(missing.withColumn("gap", F.lit(True)), ["doc_id", "page_number", "line_index"], "left").withColumn("gap", F.coalesce("gap", F.lit(False)))
    path = F.when(F.col("gap") | (F.col("level") == 0), F.col("label")).otherwise(X.section_path(F.col("label")))
    return joined.withColumn("path", path).drop("epoch")


def section_spans(lined: DataFrame) -> DataFrame:
    """Spans of each document: ``page_number, line_index, label, section_title, section_path, risk, page_end``.

    A span ends on the page before the next heading's, or on its own; the last one on the document's last page with a line.
    """
    last = lined.groupBy("doc_id").agg(F.max("page_number").alias("last_page"))
    order = Window.partitionBy("doc_id").orderBy("page_number", "line_index")
    placed = headings(lined).withColumn("next_page", F.lead("page_number").over(order)).join(last, "doc_id")
    end = F.greatest("page_number", F.coalesce(F.col("next_page") - 1, F.col("last_page")))
    risk = F.when(F.col("gap"), "section_hierarchy_gap").otherwise("")
    return placed.select("doc_id", "page_number", "line_index", "label", F.col("title").alias("section_title"), F.col("path").alias("section_path"), risk.alias("risk"), end.cast("int").alias("page_end"))


def structure_hints(docs: DataFrame) -> DataFrame:
    """What each line of a text hints at: ``kind, label, title, section_path, risk`` and its place in the text.

    Kinds: section, annex, table, ambiguous_section (short, in capitals or titles), form_field. The first that fits counts.
    """
    lines = source_lines(docs).where("line <> ''").withColumn("page_number", F.lit(1))
    sections = headings(lines).select("doc_id", "line_index", F.col("label").alias("own"), F.col("title").alias("own_title"), "path", "gap")
    line = F.col("line")
    whole = lambda pattern, k: F.regexp_extract(line, pattern, k)
    letters = line.rlike(r"\p{L}")
    capital = (F.upper(line) == line) & (F.lower(line) != line)
    # each run of letters begins with a capital and goes on in small letters
    titled = line.rlike(r"\p{Lu}") & ~line.rlike(r"(?:^|[^\p{L}])\p{Ll}|\p{L}\p{Lu}")
    words = F.size(F.filter(F.split(line, r"\s+"), lambda x: x != ""))
    plain = (F.length(line) <= AMBIGUOUS_CHARS) & ~line.rlike(r"[:|]") & ~line.rlike(r"[.,]$") & letters & (words <= AMBIGUOUS_WORDS)
    field = line.rlike(FORM_FIELD) & ~line.startswith("|")
    kind = F.when(F.col("own").isNotNull(), "section").when(line.rlike(ANNEX_HEADING), "annex").when(line.rlike(TABLE_HEADING), "table").when(plain & (capital | titled), "ambiguous_section").when(field, "form_field")
    marked = lines.join(sections, ["doc_id", "line_index"], "left").withColumn("kind", kind).where("kind IS NOT NULL")
    by = lambda **values: F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in values.items()])
    label = by(section=F.col("own"), annex=whole(ANNEX_HEADING, 1), table=whole(TABLE_HEADING, 1), ambiguous_section=line, form_field=F.trim(whole(FORM_FIELD, 1)))
    title = by(section=F.col("own_title"), annex=F.trim(whole(ANNEX_HEADING, 2)), table=F.trim(whole(TABLE_HEADING, 2)), ambiguous_section=line, form_field=F.trim(whole(FORM_FIELD, 2)))
    risk = F.when(F.col("gap"), "section_hierarchy_gap").when(F.col("kind") == "ambiguous_section", "ambiguous_section_heading").otherwise("")
    return marked.select("doc_id", "line_index", "kind", label.alias("label"), F.when(title != "", title).alias("title"), F.col("path").alias("section_path"), risk.alias("risk"), "char_start", "char_end")


def normalized_spans(raw: DataFrame) -> DataFrame:
    """Spans as chunks take them: earlier names are read too, spans without page, line, path, title or kind are left out.

    ``doc_id, page_start, page_number, page_end, line_index, section_path, section_title, title, kind, risk_codes`` in; codes
    come sorted and once. A page zero counts as missing.
    """
    some = lambda x: F.nullif(F.col(x), F.lit(""))
    page = lambda x: F.nullif(F.col(x), F.lit(0))
    first = F.coalesce(page("page_start"), "page_number")
    codes = F.array_sort(F.array_distinct(F.filter(F.coalesce("risk_codes", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))
    picked = raw.select("doc_id", first.alias("page_start"), F.coalesce(page("page_end"), first).alias("page_end"), "line_index", some("section_path").alias("section_path"), F.coalesce(some("section_title"), some("title")).alias("section_title"), some("kind").alias("kind"), codes.alias("risk_codes"))
    return picked.dropna(subset=["page_start", "line_index", "section_path", "section_title", "kind"])


def boilerplate_places(lined: DataFrame) -> DataFrame:
    """``doc_id, page_number, line_index`` of first and last lines that recur on half of a document's pages, two at least."""
    line = F.struct("line_index", "line")
    edges = lined.groupBy("doc_id", "page_number").agg(F.min(line).alias("first"), F.max(line).alias("last"))
    each = edges.select("doc_id", "page_number", F.explode(F.array(F.struct(F.lit("first").alias("edge"), F.col("first").alias("at")), F.struct(F.lit("last").alias("edge"), F.col("last").alias("at")))).alias("e"))
    keyed = each.select("doc_id", "page_number", "e.edge", F.col("e.at.line_index").alias("line_index"), X.boilerplate_key(F.col("e.at.line")).alias("key"))
    pages = edges.groupBy("doc_id").agg(F.count("*").alias("pages"))
    often = keyed.groupBy("doc_id", "edge", "key").agg(F.count("*").alias("n")).join(pages, "doc_id").where("pages >= 2 AND n >= greatest(2, floor((pages + 1) / 2))")
    return keyed.join(often.select("doc_id", "edge", "key"), ["doc_id", "edge", "key"]).select("doc_id", "page_number", "line_index").distinct()


def span_drafts(lined: DataFrame, spans: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """A draft for each span with text: its lines up to the next span, without boilerplate.

    ``lined`` as for ``headings``, ``spans`` as of ``normalized_spans``. A section reaches to its page's end, or onto the next
    heading's page if that heading does not begin it. Lines before the first span belong to none. ``page_start`` and ``page_end``
    are those of the lines used.
    """
    order = Window.partitionBy("doc_id").orderBy("page_start", "line_index", "section_path")
    ahead = {"span": F.row_number().over(order), "next_page": F.lead("page_start").over(order), "next_line": F.lead("line_index").over(order)}
    placed = spans.withColumns(ahead)
    reach = F.when((F.col("next_page") > F.col("page_end")) & (F.col("next_line") > 0), F.col("next_page")).otherwise(F.col("page_end"))
    placed = placed.withColumn("reach", reach)
    opened = placed.select("doc_id", F.col("page_start").alias("page"), "line_index", F.lit(0).alias("kind"), F.col("span").alias("tie"), F.struct("span", "reach").alias("opens"), F.lit(None).cast("string").alias("line"))
    none = F.lit(None).cast(opened.schema["opens"].dataType)
    texts = lined.join(boilerplate, ["doc_id", "page_number", "line_index"], "left_anti").select("doc_id", F.col("page_number").alias("page"), "line_index", F.lit(1).alias("kind"), F.lit(0).alias("tie"), none.alias("opens"), X.trimmed(F.col("line")).alias("line"))
    running = Window.partitionBy("doc_id").orderBy("page", "line_index", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0)
    held = opened.unionByName(texts).withColumn("held", F.last("opens", ignorenulls=True).over(running)).where("kind = 1 AND line <> '' AND page <= held.reach")
    within = held.select("doc_id", F.col("held.span").alias("span"), "page", "line_index", "line")
    # a span whose last page lies beyond the next span's page has the pages after that one, too
    over = placed.where("page_end > next_page").select("doc_id", "span", F.explode(F.sequence(F.col("next_page") + 1, F.col("page_end"))).alias("page"))
    beyond = over.join(texts.where("line <> ''"), ["doc_id", "page"]).select("doc_id", "span", "page", "line_index", "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_index", "line"))), lambda x: x["line"]), "\n")
    grouped = within.unionByName(beyond).groupBy("doc_id", "span").agg(text.alias("text"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    known = placed.select("doc_id", "span", "section_path", "section_title", "kind", "risk_codes")
    position = F.col("span").cast("long")
    return grouped.join(known, ["doc_id", "span"]).select("doc_id", position.alias("position"), "section_path", "section_title", "kind", "risk_codes", F.col("first_page").cast("int").alias("page_start"), F.col("last_page").cast("int").alias("page_end"), "text")


def merge_short(drafts: DataFrame, least: int = D.MIN_CHUNK_CHARS) -> DataFrame:
    """Drafts of fewer than ``least`` characters joined to the next of the same section path; the last stays as it is.

    ``doc_id, position, section_path, text`` and, where they are there, ``section_title, kind, page_start`` of the first part,
    ``page_end`` of the last and ``risk_codes`` of both. Drafts are sorted within partitions dealt by document and streamed: a
    task holds one chunk. A null path counts as the empty one.
    """
    first = [x for x in ("section_title", "kind", "page_start") if x in drafts.columns]
    risky, paged = "risk_codes" in drafts.columns, "page_end" in drafts.columns
    names = ["doc_id", "position", "section_path", "text", *first, *["page_end"] * paged, *["risk_codes"] * risky]
    picked = drafts.select("doc_id", F.col("position").cast("long").alias("position"), F.coalesce("section_path", F.lit("")).alias("section_path"), *names[3:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                if held is not None:
                    if len(held["text"]) < least and (held["doc_id"], held["section_path"]) == (row["doc_id"], row["section_path"]):
                        row |= {"text": f"{held['text']}\n\n{row['text']}".strip(), "position": held["position"]} | {x: held[x] if held[x] is not None else row[x] for x in first}
                        if risky:
                            row["risk_codes"] = sorted({*held["risk_codes"], *row["risk_codes"]})
                    elif held["text"].strip():
                        out.append(held)
                held = row
            yield pd.DataFrame(out, columns=names)
        if held is not None and held["text"].strip():
            yield pd.DataFrame([held], columns=names)

    dealt = picked.repartition("doc_id").sortWithinPartitions("doc_id", "position")
    return dealt.mapInPandas(run, picked.schema)


def industrial_chunks(lined: DataFrame, spans: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """Chunks of documents with section spans, one a section whatever its length, short ones merged, numbered and hashed."""
    order = Window.partitionBy("doc_id").orderBy("position")
    merged = merge_short(span_drafts(lined, spans, boilerplate))
    text = F.col("text")
    return merged.select(
        "doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), "section_path", "section_title", "kind", F.array_join("risk_codes", ",").alias("risk_codes"), "page_start", "page_end",
        text, F.length(text).alias("char_count"), X.chunk_tokens(text).alias("token_estimate"), F.sha2(text, 256).alias("chunk_hash"),
    )


def chunk_documents(docs: DataFrame) -> DataFrame:
    """The generic path from texts to chunks: sections, blocks, short ones merged, then numbered and hashed."""
    cut = D.blocks(D.sections(docs))
    drafts = cut.select("doc_id", (F.col("section_index") * 1_000_000 + F.col("block_index")).alias("position"), F.lit("").alias("section_path"), F.col("block").alias("text"))
    order = Window.partitionBy("doc_id").orderBy("position")
    return merge_short(drafts).select(
        "doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), "text", F.length("text").alias("char_count"), X.chunk_tokens(F.col("text")).alias("token_estimate"), F.sha2("text", 256).alias("chunk_hash")
    )


def chunk_sources(paged: DataFrame, spans: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """Chunks of every document of ``paged``: by section where its spans give any, else by headings and windows."""
    lined = D.lines(paged)
    own = industrial_chunks(lined, spans, boilerplate)
    rest = paged.join(own.select("doc_id").distinct(), "doc_id", "left_anti")
    # windows, profiles and gates work by page; the generic way joins a document's pages
    generic = chunk_documents(rest.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n").alias("text")))
    return own.unionByName(generic, allowMissingColumns=True)
