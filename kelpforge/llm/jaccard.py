"""Documents whose sets of word shingles are alike, by prefixes that adapt to what they cost.

The tokens of each set are put into one order for all, rare ones first. Two sets that share a tokens also share m tokens
among the first n - a + m of either. So each document chooses how far its prefix reaches, m = 1, 2, 3 ... by the candidates
it must expect from the frequency of its tokens, and two documents are candidates only if they share as many prefix
tokens as the smaller of their two choices. What is left is judged by the exact intersection.

Groups of copies do not give all their pairs: equal sets are one class, the classes of a token are first held against the
one that has the token earliest, and only classes that this leaves in different components are paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import UNBLANK, hashes, runs, scan
from .common import discard, join_few, materialize, slices, table
from .components import connected_components

#: Words of a shingle. Documents link if 5 times what they share is at least 4 times their union.
WORDS = 5
#: The order knows the frequencies of so many tokens at most, the most frequent ones (16 MB, at every size of input). They are summed from
#: those that a task meets in two sets or more; every other token counts as rare.
FREQUENT = 1 << 20
#: The most tokens that a document may ask for, and what a candidate costs against a meeting of two tokens.
MOST, CANDIDATE = 8, 16.0
#: A task remembers so many classes that it has dealt with.
SEEN = 1_000_000
#: A task counts so many tokens at a time.
HELD = 8_000_000


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``row, token`` of each row's set, in order of both."""
    found = scan(column, UNBLANK)
    row, token = runs(found, hashes(found), words, short=True)
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    return row[new], token[new]


def _classes(token: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each row's set."""
    from xxhash import xxh64_intdigest

    data, ends = token.astype("<u8").tobytes(), np.cumsum(sizes).tolist()
    return np.array([xxh64_intdigest(data[8 * (b - n) : 8 * b]) for b, n in zip(ends, sizes.tolist(), strict=True)], np.uint64).view(np.int64)


def _fresh(classes: np.ndarray, sizes: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows have a set that the task has not met."""
    out = sizes > 0
    for k in np.flatnonzero(out).tolist():
        if (c := int(classes[k])) in seen:
            out[k] = False
        else:
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(c)
    return out


def _marked(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``doc_id, n, class`` of each row; the frequent tokens in ascending order, and how many different sets have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, names = [], set(), ["doc_id", "n", "class", "token", "met"]
        for batch in slices(batches):
            row, token = shingle_sets(batch.column(1), words)
            sizes = np.bincount(row, minlength=batch.num_rows)
            classes = _classes(token, sizes)
            held.append(token[_fresh(classes, sizes, seen)[row]])
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, mask=sizes == 0), none, none], names=names)
            if sum(map(len, held)) > HELD:
                yield from told(held, names)
                held = []
        if held:
            yield from told(held, names)

    def told(held: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
        token, met = np.unique(np.concatenate(held), return_counts=True)
        token, met = token[met > 1].view(np.int64), met[met > 1]
        none = pa.nulls(len(token), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(token), pa.array(met, pa.int64())], names=names)

    both = materialize(docs.mapInArrow(run, "doc_id long, n long, class long, token long, met long"), "shingle-classes")
    summed = both.where("token IS NOT NULL").groupBy("token").agg(F.sum("met").alias("met"))
    found = summed.orderBy(F.desc("met"), "token").limit(FREQUENT).toArrow()
    token, met = (found.column(x).to_numpy() for x in ("token", "met"))
    order = np.argsort(token.view(np.uint64))
    return both.where("token IS NULL").select("doc_id", "n", "class"), token.view(np.uint64)[order], met[order]


def least_shared(n: np.ndarray) -> np.ndarray:
    """What a set of n tokens must share with the smallest set that can be like it."""
    smaller = -(-4 * n // 5)
    return -(-4 * (n + smaller) // 9)


def choices(n: np.ndarray, met: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many shared tokens each row asks for: the choice with the least expected cost.

    ``met`` holds how many other sets have each token, row by row in the order of prefixes. A prefix that reaches a token
    meets all of them, and a candidate takes as many meetings as are asked for. Expected are partners of the row's own size.
    """
    running = np.concatenate([[0], np.cumsum(met)])
    best, chosen = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for m in range(1, MOST + 1):
        reach = n + 8 * n // -9 + m
        able = (n > 0) & (m <= least_shared(n))
        meetings = running[np.where(able, first + np.minimum(reach, n), 0)] - running[np.where(able, first, 0)]
        cost = np.where(able, reach + meetings + CANDIDATE * meetings / m, np.inf)
        better = cost < best
        best[better], chosen[better] = cost[better], m
    return chosen


def prefixes(docs: DataFrame, frequent: np.ndarray, sets: np.ndarray, words: int) -> DataFrame:
    """``class, n, asked, tokens``: the prefix of each set that the task meets for the first time, in the common order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            row, token = shingle_sets(batch.column(1), words)
            sizes = np.bincount(row, minlength=batch.num_rows)
            classes = _classes(token, sizes)
            keep = _fresh(classes, sizes, seen)[row]
            row, token = row[keep], token[keep]
            at = np.minimum(np.searchsorted(frequent, token), max(len(frequent) - 1, 0))
            met = np.where(frequent[at] == token, sets[at], 1) if len(frequent) else np.ones(len(token), np.int64)
            order = np.lexsort((token, met, row))
            row, token, met = row[order], token[order], met[order]
            n = np.bincount(row, minlength=batch.num_rows)
            first = np.cumsum(n) - n
            asked = choices(n, met - 1, row, first)
            place = np.arange(len(row)) - first[row]
            within = place < (n - least_shared(n) + asked)[row]
            new = n > 0
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[within], minlength=batch.num_rows)[new])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(token[within].view(np.int64)))
            columns = [pa.array(classes[new]), *[pa.array(x[new].astype(np.int32)) for x in (n, asked)], lists]
            yield pa.RecordBatch.from_arrays(columns, names=["class", "n", "asked", "tokens"])

    return docs.mapInArrow(run, "class long, n int, asked int, tokens array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """``class, tokens`` of each set that a task meets for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            row, token = shingle_sets(batch.column(1), words)
            sizes = np.bincount(row, minlength=batch.num_rows)
            classes = _classes(token, sizes)
            new = _fresh(classes, sizes, seen)
            ends = np.concatenate([[0], np.cumsum(sizes[new])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(token[new[row]].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(classes[new]), lists], names=["class", "tokens"])

    return docs.mapInArrow(run, "class long, tokens array<long>")


def _alike(shared: Column, n: Column, m: Column) -> Column:
    return 9 * shared >= 4 * (n + m)


def _counted(pairs: DataFrame, reach: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pairs that share as many tokens of their whole prefixes as they must.

    What two sets share beyond these tokens lies in the rest of the one whose prefix ends first in the common order, so it is
    no more than the longer of their rests.
    """
    held = join_few(reach, wanted, "class", "inner").groupBy("class").agg(F.first("tokens").alias("own"), F.min("n").alias("n"), F.min("asked").alias("asked"))
    held = held.withColumn("rest", F.expr("(4 * (n + (4 * n + 4) DIV 5) + 8) DIV 9 - asked"))
    for end in ("a", "b"):
        pairs = pairs.join(held.select(F.col("class").alias(end), *[F.col(x).alias(f"{end}_{x}") for x in ("own", "n", "rest")]), end)
    least = F.expr("(4 * (a_n + b_n) + 8) DIV 9 - greatest(a_rest, b_rest)")
    return pairs.where(F.size(F.array_intersect("a_own", "b_own")) >= least).select("a", "b")


def _verified(pairs: DataFrame, reach: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are alike: by their prefixes first, then by the exact intersection of the sets of those left."""
    ends = lambda rows: rows.select(F.col("a").alias("class")).union(rows.select("b")).distinct()
    first = materialize(pairs, "pairs")
    judged = materialize(ends(first), "judged")
    pairs = materialize(_counted(first, reach, judged), "pairs")
    wanted = materialize(ends(pairs), "wanted")
    met = join_few(_sets(docs, words), wanted, "class", "inner")
    sets = materialize(met.groupBy("class").agg(F.first("tokens").alias("tokens")), "sets")
    left = sets.join(pairs.select(F.col("a").alias("class")).distinct(), "class").select(F.col("class").alias("a"), F.col("tokens").alias("a_set"))
    both = pairs.join(sets.select(F.col("class").alias("b"), F.col("tokens").alias("b_set")), "b").join(left, "a")
    links = materialize(both.where(_alike(F.size(F.array_intersect("a_set", "b_set")), F.size("a_set"), F.size("b_set"))).select("a", "b"), "links")
    discard(first, judged, pairs, wanted, sets)
    return links


def _earliest(postings: DataFrame) -> DataFrame:
    """``a, b``: each class with the one that has most of its tokens earliest, if those are a part of its prefix to speak of.

    These links only spare pairs: what is not linked here is paired by ``_apart``.
    """
    order = F.struct((F.col("place") * 1000 / F.col("n")).cast("int").alias("at"), (-F.col("n")).alias("less"), F.col("class").alias("a"), F.col("n").alias("m"))
    first = postings.groupBy("token").agg(F.min(order).alias("first")).select("token", "first.a", "first.m")
    met = postings.join(first, "token").where("class <> a AND 5 * least(n, m) >= 4 * greatest(n, m)")
    votes = met.groupBy("a", F.col("class").alias("b")).agg(F.count("*").alias("votes"), F.min("n").alias("n")).where("votes * 20 >= n")
    best = votes.groupBy("b").agg(F.max(F.struct("votes", "a")).alias("best"))
    return best.select(F.col("best.a").alias("a"), "b")


def _apart(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """``a, b``: pairs of classes in different components that share as many prefix tokens as one of them asks for.

    Of each token the largest component is not paired with itself: its classes meet only those of the others.
    """
    rooted = postings.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    rooted = materialize(rooted, "rooted")
    parts = rooted.groupBy("token", "root").agg(F.count("*").alias("k"))
    mixed = parts.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("k", "root")).alias("most")).where("lo < hi").select("token", F.col("most.root").alias("major"))
    left = materialize(rooted.join(mixed, "token"), "mixed")
    x = left.where("root <> major").select("token", *[F.col(c).alias(f"x_{c}") for c in ("class", "root", "n", "place", "asked")])
    y = left.select("token", "major", *[F.col(c).alias(f"y_{c}") for c in ("class", "root", "n", "place", "asked")])
    total, asked = F.expr("(4 * (x_n + y_n) + 8) DIV 9"), F.least("x_asked", "y_asked")
    near = (F.col("x_place") < F.col("x_n") - total + asked) & (F.col("y_place") < F.col("y_n") - total + asked)
    once = (F.col("y_root") == F.col("major")) | (F.col("x_class") < F.col("y_class"))
    sizes = F.expr("5 * least(x_n, y_n) >= 4 * greatest(x_n, y_n)")
    met = x.join(y, "token").where((F.col("x_root") != F.col("y_root")) & once & sizes & near)
    pairs = met.groupBy(F.least("x_class", "y_class").alias("a"), F.greatest("x_class", "y_class").alias("b")).agg(F.count("*").alias("votes"), F.min(asked).alias("asked"))
    return pairs.where("votes >= asked").select("a", "b")


def shingle_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    A set holds the distinct runs of ``words`` words, A-Z in lower case; fewer words are one run; without words it is empty
    and links with nothing, so that the component is the row's own id. Tokens and classes of equal sets are 64-bit hashes.
    ``component_id`` is the smallest id reachable; a null id is one only where all ids there are null; ids are cast to long;
    repeated rows give repeated rows, and rows of one id but different texts are judged each; other columns are ignored; an
    empty table gives no rows. Links are exact: candidates are lost to no cap.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked, frequent, sets = _marked(own, words)
    reach = materialize(prefixes(own, frequent, sets, words), "prefixes")
    placed = reach.select("class", "n", "asked", F.posexplode("tokens").alias("place", "token"))  # ``place``: in the common order of its set
    shared = materialize(placed.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token"), "shared-tokens")
    postings = materialize(join_few(placed, shared, "token", "inner").dropDuplicates(["token", "class"]), "postings")
    discard(shared)
    links = _verified(_earliest(postings), reach, own, words)
    roots = materialize(connected_components(links), "roots")
    more = _verified(_apart(postings, roots), reach, own, words)
    if not more.isEmpty():
        roots = materialize(connected_components(links.union(more)), "roots")
    discard(reach, postings)
    nodes = marked.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    linked = nodes.join(roots.withColumnRenamed("node", "class"), "class")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select("class", "component_id")
    alone = nodes.where("copies > 1").join(named, "class", "left_anti").select("class", F.col("least").alias("component_id"))
    joined = marked.join(named.union(alone), "class", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op13_ngram_jaccard(spark, sf_dir):
    return shingle_components(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT r, CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS s
      FROM w WHERE len(words) > 0),
classes AS (SELECT list_sort(s) AS s, min(r) AS c, len(s) AS n FROM g GROUP BY list_sort(s), len(s)),
tokens AS (SELECT c, n, unnest(s) AS token FROM classes),
pairs AS (SELECT x.c AS a, y.c AS b FROM tokens AS x JOIN tokens AS y ON x.token = y.token AND x.c < y.c AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
          GROUP BY x.c, y.c, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT c AS a, c AS b FROM classes UNION SELECT reached.a, edges.b FROM reached JOIN edges ON reached.b = edges.a),
root AS (SELECT a AS c, min(b) AS root FROM reached GROUP BY a),
member AS (SELECT g.r, root, len(g.s) AS n FROM g JOIN classes ON list_sort(g.s) = classes.s JOIN root ON root.c = classes.c),
least_ AS (SELECT root, min(doc_id) AS component_id FROM member JOIN d USING (r) GROUP BY root)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN member USING (r) LEFT JOIN least_ USING (root)
"""
