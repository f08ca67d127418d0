"""Quality rules: word statistics of each text and the frequency of its lines among the documents of its host.

Only built-in column functions are used. Lines are hashed and counted over all documents; a line that more than
``LINE_PERCENT`` of a host's distinct texts carry is boilerplate and is removed; a document that loses too much with it is
rejected. Exact copies count as one document, so that copying a document does not turn its lines into boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, materialize, table

MIN_WORDS = 10
#: Percent of the words that may lie in repeated windows.
MAX_REPEATED = 20
WINDOW = 5
#: A line is above the limit if it is in more distinct texts of its host than this number and this percentage.
LINE_TEXTS = 10
LINE_PERCENT = 10
#: A document is depleted if fewer than MIN_WORDS words, or less than this percentage of them, are left.
MIN_LEFT_PERCENT = 30
#: Frequent lines are broadcast up to this number of them, and joined by a shuffle beyond.
BROADCAST_LINES = 500_000


def here(value: Column) -> Column:
    """The value, computed in this projection: a filter above is not pushed below it, which would write the whole
    expression out again inside the functions that read it for each element."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda x: x != "")


def line_hash(line: Column) -> Column:
    """Hash of a line in lower case, its white space collapsed and trimmed."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, BLANKS, " "))))


def _lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def with_statistics(docs: DataFrame, text: str = "_text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the column ``text`` (null: no words)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = docs.withColumns({"_words": words_of(t), "_lines": _lines(t)}).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.regexp_replace(t, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hash": F.transform("_words", lambda x: F.xxhash64(x)),
        }
    )
    # Each column below is read at least twice by the next, so that the optimiser computes it once for a row.
    at = F.sequence(F.lit(0), F.size("_hash") - F.lit(WINDOW))
    window = F.transform(at, lambda i: F.xxhash64(*[F.get("_hash", i + k) for k in range(WINDOW)]))
    hashed = lines.withColumn("_windows", F.when(F.size("_hash") >= WINDOW, window).otherwise(F.expr("array()").cast("array<long>")))
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = hashed.withColumn("_sorted", F.when(repeats, placed))
    twin = F.filter("_sorted", lambda x, i: (x.h == F.get("_sorted", i - 1).h) | (x.h == F.get("_sorted", i + 1).h))
    starts = F.sort_array(F.transform(twin, lambda x: x.i))
    step = lambda acc, x: F.struct(x.alias("last"), (acc.n + F.least(F.lit(WINDOW), x - acc.last)).alias("n"))
    covered = F.aggregate(starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), step, lambda acc: acc.n)
    counted = ordered.withColumn("n_repeat_words", here(F.coalesce(covered, F.lit(0)).cast("long")))
    return counted.drop("_words", "_lines", "_hash", "_windows", "_sorted")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def frequent_lines(docs: DataFrame, text: str = "_text", host: str = "_host") -> DataFrame:
    """``_host, _frequent``: for each host the sorted hashes of its lines above the limits.

    Distinct texts are counted, in two steps: the first spreads each line by text, so that a line or host that fills a
    third of the corpus is summed in all tasks. Each text also yields the mark null, whose count is the host's total.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    marks = F.concat(F.array(F.lit(None).cast("long")), F.array_distinct(F.transform(_lines(t), line_hash)))
    seen = docs.select(host, F.xxhash64(t).alias("_doc"), F.explode(marks).alias("_line")).distinct()
    counts = seen.groupBy(host, "_line").agg(F.count("*").alias("_n")).where(F.col("_line").isNull() | (F.col("_n") > LINE_TEXTS))
    counts = materialize(counts, "line-counts")
    totals = counts.where(F.col("_line").isNull()).select(host, F.col("_n").alias("_total"))
    above = counts.where(F.col("_line").isNotNull()).join(totals, host).where(100 * F.col("_n") > LINE_PERCENT * F.col("_total"))
    return materialize(above.groupBy(host).agg(F.sort_array(F.collect_list("_line")).alias("_frequent")), "frequent-lines")


def judge(docs: DataFrame, *, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """All columns of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text.

    ``clean_text`` is the text without the lines above the limits. A null text has no words and fails; a null host counts
    as the empty one; repeated rows are judged each; an empty table gives no rows. Columns of the input whose names
    are among the added ones are replaced. What each host contributes to the broadcast is bounded by its mean number
    of lines a text over LINE_PERCENT; its size is checked, and beyond BROADCAST_LINES the join shuffles.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]
    rest = [x for x in docs.columns if x not in added]
    own = docs.select(F.struct(*[docs[x] for x in docs.columns]).alias("_row"), docs[text_col].cast("string").alias("_text"), F.coalesce(docs[host_col].cast("string"), F.lit("")).alias("_host"))
    frequent = frequent_lines(own)
    n = frequent.agg(F.coalesce(F.sum(F.size("_frequent")), F.lit(0)).alias("n")).first()["n"]
    joined = with_statistics(own).join(F.broadcast(frequent) if n <= BROADCAST_LINES else frequent, "_host", "left")
    t = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.split(t, "\n", -1)
    hit = F.col("_frequent").isNotNull() & F.arrays_overlap(F.transform(_lines(t), line_hash), F.col("_frequent"))
    left = F.array_join(F.filter(lines, lambda x: ~F.array_contains("_frequent", line_hash(x))), "\n")
    cleaned = joined.withColumn("clean_text", F.when(hit, left).otherwise(t))
    n_left = F.when(F.col("clean_text") == t, F.col("n_words")).otherwise(F.size(words_of(F.col("clean_text"))))
    depleted = (n_left < MIN_WORDS) | (100 * n_left < MIN_LEFT_PERCENT * F.col("n_words"))
    judged = cleaned.withColumn("base_failed", base_failed()).withColumn("kept", here(~F.col("base_failed") & ~depleted))
    return judged.select(*[F.col(f"_row.`{x}`").alias(x) for x in rest], *added)


def op8_quality_rules(spark, sf_dir):
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(docs: DataFrame) -> DataFrame:
    """The documents kept, without their boilerplate lines."""
    kept = judge(docs).where("kept")
    changed = kept.withColumns({"n_chars": F.when(F.col("clean_text") != F.col("text"), F.length("clean_text").cast("long")).otherwise(F.col("n_chars")), "text": F.col("clean_text")})
    return changed.select(*docs.columns)


OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS g
        FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(5)) AS k) GROUP BY r),
norm AS (SELECT DISTINCT host, t, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line
         FROM (SELECT host, t, unnest(lines) AS l FROM w)),
total AS (SELECT host, count(DISTINCT t) AS total FROM d GROUP BY host),
freq AS (SELECT host, line FROM (SELECT host, line, count(*) AS n FROM norm GROUP BY host, line) JOIN total USING (host)
         WHERE n > {LINE_TEXTS} AND 100 * n > {LINE_PERCENT} * total),
lost AS (SELECT r, sum(len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))) AS lost
         FROM (SELECT r, host, unnest(lines) AS l FROM w) AS x
         WHERE EXISTS (SELECT 1 FROM freq WHERE freq.host = x.host AND line = lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))))
         GROUP BY r),
s AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM w LEFT JOIN cov USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)
       AND n_words - lost >= {MIN_WORDS} AND 100 * (n_words - lost) >= {MIN_LEFT_PERCENT} * n_words AS kept
FROM s
"""
