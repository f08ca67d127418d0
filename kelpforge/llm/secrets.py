"""Secret scans: pattern spans, and windows of high Shannon entropy in strings that no pattern names.

Only built-in column functions are used, so that a scan is one pass without a shuffle. Starts and ends are code points
of the whole text, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Kind, pattern, least length and what it holds for, in the order of kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
#: A run of these that is long enough is the same span as the run without the least length.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Bits a character that a window needs: of hexadecimal digits alone, and of all characters.
HEX_BITS, ANY_BITS = 3.0, 3.75
#: Candidates that are not secrets: UUIDs, runs of one character, placeholders, paths of plain words.
ALLOWED = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|(.)\1{7}|example|placeholder|changeme|dummy|^/?([a-z]{3,}[/_-])+[a-z0-9]{1,8}$"
#: c log2 c in millionths, for each count in a window: sums are exact, in Spark as in SQL.
COUNT_BITS = [0] + [round(c * math.log2(c) * 1e6) for c in range(1, WINDOW + 1)]


def most_bits(bits: float) -> int:
    """The largest sum of c log2 c at which a window has that many bits a character."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * 1e6)


def find(text: Column, pattern: str) -> Column:
    """``array<struct<s, start, end>>`` of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda s, gap: F.struct(s.alias("s"), F.length(gap).alias("gap")))
    empty = F.expr("struct(0 AS at, array() :: array<struct<s: string, start: int, end: int>> AS spans)")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        span = F.struct(x["s"].alias("s"), start.alias("start"), (start + F.length(x["s"])).alias("end"))
        return F.struct((start + F.length(x["s"])).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    none = F.expr("array() :: array<struct<s: string, start: int, end: int>>")
    return F.when(text.rlike(pattern), F.aggregate(pairs, empty, step, lambda acc: acc["spans"])).otherwise(none)


def entropy_hits(candidate: Column) -> Column:
    """``struct<first, last>``: starts of the first and last window of high entropy (null: none) in a candidate.

    The sum of c log2 c over a window's characters changes by the character that leaves and the one that enters. How often
    either stands among the characters that stay, and so the change, is found in the 19 characters next to it; the fold
    over the changes keeps four numbers. A window needs a digit and a character that is none.
    """
    text = candidate["s"]
    limit = F.when(text.rlike("^[0-9a-fA-F]+$"), most_bits(HEX_BITS)).otherwise(most_bits(ANY_BITS))
    near = WINDOW - 1

    def more(count):  # what one more of a character adds to the sum, looked up by how many there are
        return F.element_at(F.array(*[F.lit(COUNT_BITS[c + 1] - COUNT_BITS[c]) for c in range(WINDOW)]), count + 1)

    def change(chars, i):
        entering, leaving = F.get(chars, i), F.get(chars, i - WINDOW)
        before = F.slice(chars, F.greatest(i - near + 1, F.lit(1)), F.least(i, F.lit(near)))
        behind = F.slice(chars, F.greatest(i - near + 1, F.lit(1)), F.lit(near))
        digit = lambda x: F.coalesce(x.between("0", "9").cast("int"), F.lit(0))
        into = more(F.size(F.filter(before, lambda c: c == entering)))
        away = F.when(i < WINDOW, 0).otherwise(more(F.size(F.filter(behind, lambda c: c == leaving))))
        return F.struct(i.alias("i"), (into - away).alias("bits"), (digit(entering) - digit(leaving)).alias("digits"))

    def slide(acc, x):
        total, digits, start = acc["total"] + x["bits"], acc["digits"] + x["digits"], x["i"] - near
        return F.struct(total.alias("total"), digits.alias("digits"), F.when(hit(acc, x), F.coalesce(acc["first"], start)).otherwise(acc["first"]).alias("first"), F.when(hit(acc, x), start).otherwise(acc["last"]).alias("last"), acc["limit"].alias("limit"))

    def hit(acc, x):
        digits = acc["digits"] + x["digits"]
        return (x["i"] >= near) & (acc["total"] + x["bits"] <= acc["limit"]) & (digits > 0) & (digits < WINDOW)

    none = F.lit(None).cast("int")
    begin = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digits"), none.alias("first"), none.alias("last"), limit.alias("limit"))
    # lambda variables are worked out once: the characters for all changes, the changes for the fold
    split = F.array(F.filter(F.split(text, ""), lambda c: c != ""))
    changes = F.get(F.transform(split, lambda chars: F.transform(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: change(chars, i))), F.lit(0))
    return F.aggregate(changes, begin, slide, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with n_assign, n_access, n_hex, base_spans, secret_spans (arrays of start, kind, end), redacted.

    ``kind`` is the place in ``KINDS``. Candidates of high entropy are added where no base span covers them and no
    allowed form matches. ``redacted`` is the text with every span, overlapping ones joined, replaced by ``[SECRET]``.
    A null text counts as empty; ties and repeated rows are scanned each; an empty table gives no rows; columns of the
    input whose names are among the added ones are replaced.
    """
    added = ["n_assign", "n_access", "n_hex", "base_spans", "secret_spans", "redacted"]
    rest = [x for x in docs.columns if x not in added]
    own = docs.select(F.struct(*[docs[x] for x in docs.columns]).alias("_row"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_t"))
    t = F.col("_t")
    long_enough = lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 2)) >= ASSIGN_VALUE
    found = own.withColumns({"_assign": F.filter(find(t, ASSIGN), long_enough), "_access": find(t, ACCESS), "_hex": find(t, HEX), "_strings": find(t, CANDIDATE)})
    merged = found.withColumn("base_spans", F.array_sort(F.concat(_of_kind(F.col("_assign"), 0), _of_kind(F.col("_access"), 1), _of_kind(F.col("_hex"), 2))))
    open_ = F.filter("_strings", lambda x: ~x["s"].rlike(ALLOWED) & ~F.exists("base_spans", lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"])))
    judged = merged.withColumn("_hits", F.transform(open_, lambda x: F.struct(x["start"].alias("at"), entropy_hits(x).alias("hit"))))
    spans = F.transform(
        F.filter("_hits", lambda x: x["hit"]["first"].isNotNull()),
        lambda x: F.struct((x["at"] + x["hit"]["first"]).alias("start"), F.lit(3).alias("kind"), (x["at"] + x["hit"]["last"] + WINDOW).alias("end")),
    )
    fresh = F.filter(spans, lambda x: ~F.exists("base_spans", lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"])))
    full = judged.withColumn("secret_spans", F.array_sort(F.concat(F.col("base_spans"), fresh)))
    counts = {name: F.size(col).cast("long") for name, col in (("n_assign", "_assign"), ("n_access", "_access"), ("n_hex", "_hex"))}
    return full.withColumns({**counts, "redacted": _redacted(t, F.col("secret_spans"))}).select(*[F.col(f"_row.`{x}`").alias(x) for x in rest], *added)


def _redacted(text: Column, spans: Column) -> Column:
    def step(acc, x):
        apart = x["start"] >= acc["at"]
        out = F.when(apart, F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("[SECRET]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1))))


def op5_secret_scan(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_written(F.col("base_spans")), 256).alias("base_sha256"), _written(F.col("secret_spans")).alias("spans"))


def stage(docs: DataFrame) -> DataFrame:
    """All documents, their secrets replaced."""
    found = scan(docs)
    changed = F.size("secret_spans") > 0
    return found.withColumns({"text": F.when(changed, F.col("redacted")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))}).select(*docs.columns)


_ASSIGN_SQL = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_ALLOWED_SQL = "(?i)" + "|".join([r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "example|placeholder|changeme|dummy", r"^/?([a-z]{3,}[/_-])+[a-z0-9]{1,8}$", *[f"{x}{{8}}" for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789/_=-"], r"\+{8}"])


def _find_sql(name: str, pattern: str) -> str:
    return f"""{name} AS (SELECT r, unnest(m) AS s, unnest(list_transform(range(1, len(m) + 1), lambda i:
      list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS start
    FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d WHERE regexp_matches(t, '{pattern}')))"""


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{_find_sql("a0", _ASSIGN_SQL)}, {_find_sql("a1", ACCESS)}, {_find_sql("a2", HEX)}, {_find_sql("c0", CANDIDATE)},
base AS (SELECT r, 0 AS kind, start, start + length(s) AS e FROM a0 WHERE length(regexp_extract(s, '{_ASSIGN_SQL}', 1)) >= {ASSIGN_VALUE}
  UNION ALL SELECT r, 1, start, start + length(s) FROM a1 UNION ALL SELECT r, 2, start, start + length(s) FROM a2),
cand AS (SELECT row_number() OVER () AS c, * FROM c0 WHERE NOT regexp_matches(s, '{_ALLOWED_SQL}')
  AND NOT EXISTS (SELECT 1 FROM base WHERE base.r = c0.r AND base.start <= c0.start AND base.e >= c0.start + length(s))),
win AS (SELECT c, i, w, regexp_matches(s, '^[0-9a-fA-F]+$') AS hex FROM (SELECT c, s, i, s[i + 1:i + {WINDOW}] AS w
  FROM (SELECT c, s, unnest(range(0, length(s) - {WINDOW - 1})) AS i FROM cand))),
chars AS (SELECT c, i, any_value(hex) AS hex, any_value(w) AS w, sum(({COUNT_BITS})[n + 1]) AS total FROM
  (SELECT c, i, hex, w, ch, count(*) AS n FROM (SELECT c, i, hex, w, unnest(string_split(w, '')) AS ch FROM win) GROUP BY ALL) GROUP BY c, i),
hit AS (SELECT c, min(i) AS f, max(i) AS l FROM chars WHERE total <= CASE WHEN hex THEN {most_bits(HEX_BITS)} ELSE {most_bits(ANY_BITS)} END
  AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[^0-9]') GROUP BY c),
ent AS (SELECT r, 3 AS kind, start + f AS start, start + l + {WINDOW} AS e FROM hit JOIN cand USING (c)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM ent WHERE NOT EXISTS
  (SELECT 1 FROM base WHERE base.r = ent.r AND base.start <= ent.start AND base.e >= ent.e)),
written AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h,
  string_agg(w, ',' ORDER BY start, kind, e) FILTER (kind < 3) AS b, string_agg(w, ',' ORDER BY start, kind, e) AS s
  FROM (SELECT *, ({KINDS})[kind + 1] || ':' || start || ':' || e AS w FROM every) GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans FROM d LEFT JOIN written USING (r)
"""
