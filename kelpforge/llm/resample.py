"""Importance resampling: documents drawn in favour of those that read like a target corpus.

Both corpora are counted as hashed runs of words. A bucket's gain is the logarithm of its share in the target over its
share in the corpus; a document weighs the sum of its gains; Gumbel noise from a hash of its id makes the largest scores a
draw without replacement. Words, runs and their CRC-32 come from the bytes of whole Arrow columns (``bytewords``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import ALPHANUMERIC, Words, crc32, scan
from .common import materialize, slices, table

#: Buckets, the most words of a feature, the noise's seed, the least words of a document that can be drawn, percent drawn.
BUCKETS, RUN, SEED, MIN_WORDS, PERCENT = 10_000, 1, 2024, 20, 10


def spaced(words: Words) -> Words:
    """The same words, laid out with one space after each."""
    length = words.ends - words.starts
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    data = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    shift = np.repeat(words.starts - starts, length)
    at = np.arange(len(shift)) + np.repeat(np.arange(len(length)), length)  # one more for each space before
    data[at] = words.data[at + shift]
    return Words(data, starts, ends, words.row, words.rows)


def features(words: Words, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """``row, bucket`` of each run of 1 to ``longest`` words of a row."""
    if longest > 1:
        words = spaced(words)
    rows, found = [], []
    for n in range(1, longest + 1):
        first = np.arange(max(len(words.row) - n + 1, 0))
        first = first[words.row[first] == words.row[first + n - 1]]
        rows.append(words.row[first])
        found.append(crc32(words.data, words.starts[first], words.ends[first + n - 1]) % np.uint32(buckets))
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


def bucket_counts(texts: DataFrame, text_col: str = "text", *, buckets: int = BUCKETS, longest: int = RUN) -> DataFrame:
    """``bucket, n``: how often the features of all texts fall into each bucket; summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            total += np.bincount(features(scan(batch.column(0), ALPHANUMERIC), buckets, longest)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths, rounded down, from its counts in both corpora, each count with one added."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def _counted(texts: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for bucket, n in bucket_counts(texts, text_col, buckets=buckets, longest=longest).collect():  # as many rows as buckets
        out[bucket] = n
    return out


def weights(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", longest: int = RUN) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the sum of the gains of each text's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = scan(batch.column(1), ALPHANUMERIC)
            row, bucket = features(words, len(gain), longest)
            # gains are whole numbers and sums stay below 2**53, so that adding them as doubles is exact
            weight = np.bincount(row, gain[bucket], minlength=words.rows).astype(np.int64)
            columns = [words.counts(), np.bincount(row, minlength=words.rows), weight]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in columns]], names=["doc_id", "n_words", "n_features", "weight"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of the SHA-256 of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3 ... in the given order, without bringing them into one task.

    Rows are dealt by ranges of the order and numbered within their partition; the rows of the partitions before, one
    number a partition, are added. What is numbered is written first, so that all readers see the same numbers.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(dealt, "ranked")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    numbered = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return numbered.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_at", "_before")


def importance_resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    buckets: int = BUCKETS, longest: int = RUN, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for each row of ``docs``; rows that are not drawn have no rank.

    Of the N rows with ``min_words`` words or more the floor(percent * N / 100) highest scores are drawn, ties to the
    smaller id. A null or empty text has no features, weighs nothing and is not drawn, but has a score. A null id counts as the empty one in
    the noise and comes last in ties; ids are cast to long; repeated rows are scored and drawn each; other columns are
    ignored. Empty tables give no rows, an empty target no gains but those of the corpus. Counts cover all texts.
    """
    gain = gains(_counted(docs, text_col, buckets, longest), _counted(target, target_text_col, buckets, longest))
    weighed = weights(docs, gain, id_col=id_col, text_col=text_col, longest=longest)
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    first = ranked(able, *order).withColumn("rank", rank)
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark, sf_dir):
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 in SQL: its table as a list, and a step for each byte of a column ``b`` (hexadecimal digits).
SQL_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i)))"""


def sql_crc(digits: str) -> str:
    """The SQL of the CRC-32 of the bytes that ``digits`` names, beside ``crc.t``."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length({digits}) // 2),
    lambda k: ('0x' || substr({digits}, 2 * k + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])))"""


OP12_SQL = rf"""
WITH {SQL_CRC_TABLE},
lowered AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM lowered),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
u AS (SELECT r, unnest(words) AS w FROM d),
k AS (SELECT w, {sql_crc("h")} % {BUCKETS} AS k FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM u UNION SELECT w FROM b)), crc),
s AS (SELECT k, count(*) AS s FROM u JOIN k USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM b JOIN k USING (w) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM u) + {BUCKETS}) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + {BUCKETS}))))::BIGINT AS gain
      FROM s LEFT JOIN t USING (k)),
m AS (SELECT r, sum(gain) AS weight FROM u JOIN k USING (w) JOIN g USING (k) GROUP BY r),
z AS (SELECT doc_id, len(words) AS n, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM d LEFT JOIN m USING (r)),
o AS (SELECT *, row_number() OVER (PARTITION BY n >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n, weight) AS p FROM z)
SELECT doc_id, n::BIGINT AS n_features, weight, score,
  CASE WHEN n >= {MIN_WORDS} AND p <= {PERCENT} * (SELECT count(*) FROM z WHERE n >= {MIN_WORDS}) // 100 THEN p END AS rank
FROM o
"""
