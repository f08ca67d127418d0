"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Words are taken in two readings: as they stand in lower case, and as shapes that keep case, digits and punctuation but
not letters. Single words and pairs of both are hashed into ``1 << BITS`` places; a text's vector of counts has length
one; its score is the logistic function of a sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, table

BITS = 18
#: The model is fitted on at most so many labelled documents, those whose ids have the smallest hashes.
TRAIN_ROWS = 8000
EPOCHS = 3
#: Step size, its offset, and the weights of the absolute and the squared penalty.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1

_BLANKS = re.compile(r"[\x20\x09-\x0D]+")
_RUNS = re.compile(r"[^\W\d_]+|\d+|(.)\1*", re.S)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _shape(word: str) -> str:
    """``Word,`` as ``Aa,``; ``WORD!!`` as ``A!``; ``x***`` as ``a*``; ``12.3`` as ``0.0``."""

    def one(run: re.Match) -> str:
        s = run.group()
        if s[0].isalpha():
            return "a" if s.islower() else "A" if s.isupper() and len(s) > 1 else "Aa"
        return "0" if s[0].isdigit() else s[0]

    return _RUNS.sub(one, word)


class Features:
    """Places and values of a text's vector; what is known of words is kept in a table of bounded size."""

    def __init__(self, bits: int = BITS, limit: int = 1_000_000):
        self._bits, self._limit = bits, limit
        self._known: dict[str, tuple[int, int]] = {}

    def _of_word(self, word: str) -> tuple[int, int]:
        from xxhash import xxh64_intdigest

        return xxh64_intdigest(word.lower(), 1), xxh64_intdigest(_shape(word), 2)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = [x for x in _BLANKS.split(text or "") if x]
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        known = self._known
        if len(known) > self._limit:
            known.clear()
        for word in set(words).difference(known):
            known[word] = self._of_word(word)
        both = np.array([known[x] for x in words], np.uint64)
        word, shape = both[:, 0], both[:, 1]
        same = (word[1:] == word[:-1]).astype(np.uint64)
        with np.errstate(over="ignore"):
            pairs = (word[1:] * np.uint64(3) + word[:-1]) * _SPREAD
            shapes = (shape[1:] * np.uint64(3) + shape[:-1] + same) * _SPREAD
        places = np.concatenate([word, shape, pairs, shapes]) >> np.uint64(64 - self._bits)
        at, counts = np.unique(places.astype(np.int64), return_counts=True)
        return at, counts / np.sqrt(np.dot(counts, counts))


@lru_cache(maxsize=2)
def shared_features(bits: int) -> Features:
    """One table of words for each worker process, kept between its tasks."""
    return Features(bits)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for the logistic loss; the last place is the constant."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = (_logistic(w @ x) - label) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


def _logistic(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def held_out(doc_id: Column) -> Column:
    """Every third document, by crc32 of its id as text; a document without an id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights (the constant last) from at most ``rows`` labels of documents that are not held out.

    The sample's ids, of fixed number, are broadcast; its documents are turned into vectors where they lie and meet in
    one task, in the order of their hashes, so that the same rows give the same weights. Rows without a label or an id
    are left out; of rows that share an id the least text is learned, once for each label of the id, so that the task
    never holds more than ``rows`` vectors; other columns are ignored; without any row the weights are zero.
    """
    by_hash = F.xxhash64("doc_id", F.lit(3))
    usable = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    chosen = usable.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).orderBy(by_hash, "label").limit(rows)
    met = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    found = met.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = shared_features(bits)
        for batch in slices(batches):
            got = [features(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([a.astype("<i4").tobytes() for a, _ in got]), pa.array([x.astype("<f4").tobytes() for _, x in got])], names=["doc_id", "label", "at", "x"]
            )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(1 << bits), []
        for batch in batches:
            for label, at, x in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                seen.append((np.frombuffer(at, "<i4"), np.frombuffer(x, "<f4"), label))
        for _ in range(EPOCHS):
            for at, x, label in seen:
                model.learn(at, x, label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f8").tobytes()])], names=["weights"])

    numbered = found.mapInArrow(vectors, "doc_id long, label int, at binary, x binary")
    ordered = numbered.repartition(1).sortWithinPartitions(by_hash, "label", "at", "x")
    fitted = ordered.mapInArrow(fit, "weights binary").first()
    return np.frombuffer(fitted[0], "<f8") if fitted else np.zeros((1 << bits) + 1)


def score(docs: DataFrame, weights: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``doc_id, score`` for each row of ``docs``: the logistic function of the dot product, from the text alone.

    A null or empty text has an empty vector and gets the constant's score; null and repeated ids are carried as they
    are; other columns are ignored; an empty table gives no rows. The weights broadcast have a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = shared_features(bits), shared.value
        for batch in slices(batches):
            got = [features(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_logistic(w[at] @ x + w[-1]) for at, x in got], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op9_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
