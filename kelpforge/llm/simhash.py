"""SimHash fingerprints and their links, found through vantage-point trees under the Hamming distance.

Two fingerprints that differ in at most 3 of 64 bits differ in at most one bit of their high or of their low half. So
there is one vantage-point tree for each half, under that half's Hamming distance and with search radius 1, and every
pair in question meets in at least one of them. The upper part of a tree is fitted on a bounded sample and deals all
fingerprints out to shards: one home shard for each, and every shard beyond a ball's surface that the triangle
inequality cannot exclude. Each shard goes on splitting in the same way and compares what is left exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_few, materialize, slices, table
from .components import connected_components

SEED = 42
BITS = 3
#: A shard has so many fingerprints at home: a SHARDS-th of all, within these bounds. The larger a shard, the fewer copies go
#: over balls' surfaces through the shuffle, as it goes on splitting in memory. The trees are fitted on SAMPLE fingerprints at most.
SHARD, LARGEST_SHARD, SHARDS, SAMPLE = 4096, 65_536, 64, 65_536
#: Within a shard, at most so many fingerprints are compared with each other at once.
BUCKET = 1024


def shingle_hashes(text: str, words: int = 3) -> np.ndarray:
    """XXH64 of each run of ``words`` words, A-Z in lower case, repeats included."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    runs = map(b" ".join, zip(*[found[k:] for k in range(words)], strict=False))
    return np.fromiter((xxh64_intdigest(x, SEED) for x in runs), np.uint64, len(found) - words + 1)


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits, each set where over half the hashes set it; 0 for a text without words."""
    return fingerprint_of(shingle_hashes(text or "", words))


def fingerprint_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 16_384):
        part = hashes[start : start + 16_384].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: one row for each row of ``docs``; ``fp`` holds the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _half(fps: np.ndarray, half: int) -> np.ndarray:
    return (fps.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32)


def _distance(keys: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(keys ^ np.uint32(point))


def _split(keys: np.ndarray) -> tuple[int, int] | None:
    """A vantage point among the keys and the radius of its ball, or None if no ball parts them well."""
    best = None
    for point in keys[np.linspace(0, len(keys) - 1, min(len(keys), 8)).astype(int)]:
        near = np.cumsum(np.bincount(_distance(keys, point), minlength=33))
        # what lies just inside and outside the surface goes both ways
        cost = [max(near[min(r + 1, 32)], len(keys) - (near[r - 1] if r else 0)) for r in range(32)]
        radius = int(np.argmin(cost))
        if best is None or cost[radius] < best[0]:
            best = (cost[radius], int(point), radius)
    return best[1:] if best and best[0] < 0.95 * len(keys) else None


class VantageTree:
    """Nodes ``(point, radius, inside, outside)``; a negative child ``-1 - k`` is shard ``k``."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.nodes: list[list[int]] = []
        self.shards = 0
        self.root = self._grow(sample, max(1.0, len(sample) / max(shards, 1)))

    def _grow(self, keys: np.ndarray, enough: float) -> int:
        cut = _split(keys) if len(keys) > enough and len(keys) > 1 else None
        if cut is None:
            self.shards += 1
            return -self.shards
        point, radius = cut
        at = len(self.nodes)
        self.nodes.append([point, radius, 0, 0])
        near = _distance(keys, point) <= radius
        self.nodes[at][2] = self._grow(keys[near], enough)
        self.nodes[at][3] = self._grow(keys[~near], enough)
        return at

    def deal(self, keys: np.ndarray, reach: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(shard, places of keys, whether at home)``: each key at home once, and wherever a key within reach may be."""
        stack = [(self.root, np.arange(len(keys)), np.ones(len(keys), bool))]
        while stack:
            node, at, home = stack.pop()
            if not len(at):
                continue
            if node < 0:
                yield -1 - node, at, home
                continue
            point, radius, inside, outside = self.nodes[node]
            d = _distance(keys[at], point).astype(np.int64)
            into, out = d <= radius + reach, d > radius - reach
            stack.append((inside, at[into], home[into] & (d[into] <= radius)))
            stack.append((outside, at[out], home[out] & (d[out] > radius)))


def links(fps: np.ndarray, home: np.ndarray, half: int) -> list[tuple[int, int]]:
    """Links that connect all of ``fps`` that differ in at most BITS bits, of which at least one is at home.

    A spanning forest of each bucket, so that a group of n gives n - 1 links, not all its pairs.
    """
    out: list[tuple[int, int]] = []
    stack = [(fps, home)]
    while stack:
        points, own = stack.pop()
        if not own.any() or len(points) < 2:
            continue
        keys = _half(points, half)
        cut = _split(keys[own]) if own.sum() > BUCKET else None
        if cut is None:
            out += _bucket(points, own)
            continue
        point, radius = cut
        d = _distance(keys, point).astype(np.int64)
        into, outside = d <= radius + 1, d > radius - 1
        stack.append((points[into], own[into] & (d[into] <= radius)))
        stack.append((points[outside], own[outside] & (d[outside] > radius)))
    return out


def _bucket(points: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
    bits = points.view(np.uint64)
    mine = np.flatnonzero(own)
    seen = np.zeros(len(bits), bool)
    rows = max(1, 4_000_000 // len(bits))
    for start in range(0, len(mine), rows):  # which have a neighbour at all
        part = mine[start : start + rows]
        close = np.bitwise_count(bits[part, None] ^ bits[None, :]) <= BITS
        close[np.arange(len(part)), part] = False
        seen |= close.any(axis=0)
        seen[part] |= close.any(axis=1)
    left = np.flatnonzero(seen)
    out = []
    while len(left):  # grow one component at a time; what has joined is not compared again
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step, front = front[0], front[1:]
            able = np.ones(len(left), bool) if own[step] else own[left]
            near = (np.bitwise_count(bits[left] ^ bits[step]) <= BITS) & able
            if near.any():
                joined = left[near]
                out += [(int(points[step]), int(points[x])) for x in joined]
                front, left = np.concatenate([front, joined]), left[~near]
    return out


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """``a, b``: links that connect the distinct fingerprints ``fp`` within BITS bits of each other."""
    n = fps.count()
    share = min(1.0, SAMPLE / max(n, 1))
    picked = fps.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 30)) < math.ceil(share * (1 << 30)))
    sample = np.array([r[0] for r in picked.orderBy(F.xxhash64("fp", F.lit(7))).limit(SAMPLE).collect()], np.int64)
    shards = math.ceil(n / min(LARGEST_SHARD, max(SHARD, n // SHARDS)))
    trees = [VantageTree(_half(sample, half), shards) for half in (0, 1)]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy(np.int64)
            for half, tree in enumerate(trees):
                for shard, at, home in tree.deal(_half(values, half)):
                    yield pd.DataFrame({"shard": 2 * shard + half, "fp": values[at], "home": home})

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = links(group["fp"].to_numpy(np.int64), group["home"].to_numpy(bool), int(key[0]) % 2)
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    dealt = fps.select("fp").mapInPandas(deal, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(compare, "a long, b long")


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Fingerprints link at BITS or fewer differing bits; equal ones are one node however many rows have them.
    ``component_id`` is the smallest id reachable. A null or empty text has fingerprint zero and links like any other;
    a null id is never a component's id unless all ids there are null; repeated rows give repeated rows; other columns
    are ignored; an empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprint-nodes")
    roots = connected_components(fingerprint_links(nodes.select("fp")))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = linked.join(least, "root").select("fp", "component_id")
    copies = nodes.where("n > 1").join(classes, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    joined = marked.join(classes.union(copies), "fp", "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_simhash_vptree(spark, sf_dir):
    return components(table(spark, sf_dir, "documents"))


# Near-duplicates of the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. At that
# similarity fingerprints differ in about 10 of 64 bits, a radius at which no ball of a vantage-point tree prunes anything.
# So the trees find the close pairs, and bands of least hashes the candidates beyond them; both are judged exactly.
NEAR_WORDS, SIMILARITY = 5, 0.8
#: Bands of so many least hashes each: of pairs at 0.8 two in a thousand share no band, at 0.85 one in ten thousand.
BANDS, ROWS = 16, 5


def _factors(n: int) -> np.ndarray:
    """Odd random numbers, from the splitmix64 rule."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


FACTORS = _factors(BANDS * ROWS)


def bands(hashes: np.ndarray) -> list[int]:
    """A 64-bit key for each band; none for a text without words."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 1024):
        mixed = hashes[start : start + 1024, None] * FACTORS
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    data, width = least.astype("<u8").tobytes(), 8 * ROWS
    keys = [xxh64_intdigest(data[k * width : (k + 1) * width], k) for k in range(BANDS)]
    return [x - (1 << 64) if x >> 63 else x for x in keys]


def _signatures(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = [shingle_hashes(x or "", NEAR_WORDS) for x in batch.column(1).to_pylist()]
            fps = np.array([fingerprint_of(x) for x in hashes], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), pa.array([bands(x) for x in hashes], pa.list_(pa.int64()))], names=["doc_id", "fp", "bands"])

    return docs.mapInArrow(run, "doc_id long, fp long, bands array<long>")


def _shingle_sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(x or "", NEAR_WORDS).view(np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def _candidates(marked: DataFrame) -> DataFrame:
    """``a, b, votes``: each document with the smallest id of each band's key and of its fingerprint, and linked fingerprints.

    A key of n documents gives n - 1 pairs; keys are counted with map-side sums before they meet their documents.
    """
    keys = marked.select("doc_id", F.explode("bands").alias("key"))
    centres = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("most")).where("a < most").select("key", "a")
    alike = keys.join(centres, "key").where("a < doc_id").groupBy("a", F.col("doc_id").alias("b")).agg(F.count("*").alias("votes"))
    prints = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "near-fingerprints")
    equal = marked.join(prints, "fp").where("least < doc_id").select(F.col("least").alias("a"), F.col("doc_id").alias("b"), F.lit(BANDS + 1).cast("long").alias("votes"))
    linked = fingerprint_links(prints.select("fp"))
    for end in ("a", "b"):
        linked = linked.join(prints.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_doc")), end)
    linked = linked.select(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b"), F.lit(BANDS).cast("long").alias("votes"))
    return alike.union(equal).union(linked).groupBy("a", "b").agg(F.max("votes").alias("votes")).where("a < b")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets are similar enough; two texts without words are alike."""
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")), "b")
    both = both.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")), "a")
    shared, total = F.size(F.array_intersect("left", "right")), F.size("left") + F.size("right")
    return both.where(shared >= SIMILARITY * (total - shared)).select("a", "b").distinct()


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` of each document that has a near-duplicate; component_id is the smallest id reachable.

    First each document is judged against the one candidate that shares most bands with it; then all candidates that are
    still in different components are judged. Ids are cast to long, what is no number becomes null, and null ids stay out;
    rows that share an id are one document, alike if any of their texts is; null and empty texts are copies of each other;
    an empty table gives no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    marked = materialize(_signatures(own), "signatures")
    pairs = materialize(_candidates(marked), "candidates")
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "candidate-ids")
    sets = materialize(_shingle_sets(join_few(own, ids, "doc_id", "inner").select("doc_id", "text")), "shingle-sets")
    best = pairs.groupBy("b").agg(F.max(F.struct("votes", (-F.col("a")).alias("less"))).alias("most")).select((-F.col("most.less")).alias("a"), "b")
    first = materialize(_similar(best, sets), "near-links")
    nodes = materialize(connected_components(first), "near-components")
    named = pairs
    for end in ("a", "b"):
        named = named.join(nodes.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    apart = named.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    second = materialize(_similar(apart, sets), "near-links")
    if not second.isEmpty():
        nodes = connected_components(first.union(second))
    return nodes.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))


def stage(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Documents without an id stay; rows that share an id stay or go together.
    """
    gone = materialize(near_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_gone")), "near-duplicates")
    keyed = docs.withColumn("_id", F.col("doc_id").cast("long"))
    return join_few(keyed, gone, "_id").where("_gone IS NULL").select(*docs.columns)
