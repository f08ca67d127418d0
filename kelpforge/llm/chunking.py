"""Substring dedup by content-defined chunking.

A gear hash rolls over the last ``WINDOW`` bytes of each text. A text is cut where the hash is the largest within ``REACH``
bytes on either side, so cuts depend on the bytes around them alone and an insertion moves only the cuts near it. The
unit that is compared over the whole corpus is two chunks in a row, by digest; units of one chunk each forward overlap,
so that a passage gives a run of copied units. A run is then extended byte by byte against the document that it was
first found in, which gives the passage's exact ends, and only then is its length judged: of passages of ``MIN_WORDS``
words or more that several documents share, the one in the document with the smallest id stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_few, materialize, slices, table

#: Bytes that the hash holds, and on how many bytes of either side a cut's hash is the largest.
WINDOW, REACH = 16, 24
#: Passages go if they have so many words or more.
MIN_WORDS = 50


def _gears() -> np.ndarray:
    """One fixed random number for each byte, from the splitmix64 rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEARS = _gears()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the rolling gear hash ``h = (h << 1) + GEARS[byte]`` of the last WINDOW bytes.

    The sum over WINDOW bytes is doubled instead of rolled: 1, 2, 4, ... bytes.
    """
    h, k = GEARS[data], 1
    while k < WINDOW:
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h, k = more, 2 * k
    return h


def chunk_ends(data: bytes, reach: int = REACH) -> list[int]:
    """Ends of the chunks of a UTF-8 text, in bytes, never within a character; the text's end is the last.

    Where several bytes within reach share the largest hash, as in repeated characters or words, the first is taken and
    the next one beyond reach, so that such stretches are cut into equal chunks and need no limit of length.
    """
    if not data:
        return []
    h = gear_hashes(np.frombuffer(data, np.uint8))
    n, full = len(h), 2 * reach + 1
    most = np.zeros(n + 2 * reach, np.uint32)
    most[reach : reach + n] = h
    width = 1
    while 2 * width <= full:
        most, width = np.maximum(most[:-width], most[width:]), 2 * width
    if width < full:
        most = np.maximum(most[: width - full], most[full - width :])
    ends, last = [], 0
    for end in (np.flatnonzero(h == most) + 1).tolist():
        if end - last <= reach:
            continue
        while end < n and data[end] & 0xC0 == 0x80:
            end += 1
        if end >= n:
            break
        ends.append(end)
        last = end
    ends.append(n)
    return ends


def units(data: bytes) -> tuple[list[int], list[int]]:
    """Cuts of a text, its start and end among them, and the digests of its units: unit k goes from cut k to cut k + 2."""
    from xxhash import xxh3_64_intdigest

    cuts = [0, *chunk_ends(data)]
    if len(cuts) < 3:
        return cuts, [xxh3_64_intdigest(data)] if data else []
    return cuts, [xxh3_64_intdigest(data[a:b]) for a, b in zip(cuts, cuts[2:], strict=False)]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _signed(digests: list[int]) -> np.ndarray:
    return np.array(digests, np.uint64).view(np.int64)


def unit_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, place, digest``: the units of each text of ``_id, _text``; of equal ones in a text the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            ids, counts, places, digests = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = units(_bytes(text))[1]
                first = dict(zip(reversed(found), range(len(found) - 1, -1, -1), strict=True))
                ids.append(doc)
                counts.append(len(first))
                places += first.values()
                digests += first
            if digests:
                docs = np.repeat(np.array(ids, np.int64), counts)
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(places, pa.int32()), pa.array(_signed(digests))], names=["doc_id", "place", "digest"])

    return docs.mapInArrow(run, "doc_id long, place int, digest long")


_RUN = "doc_id long, later boolean, first int, last int, left_doc long, left_digest long, right_doc long, right_digest long"


def _chained(doc: int, later: bool, shared: list[dict]) -> list[list]:
    """Units, in order of place, as runs of places in a row."""
    out: list[list] = []
    for x in shared:
        place, digest, partner = x["place"], x["digest"], x["partner"]
        if out and place == out[-1][3] + 1:
            out[-1][3], out[-1][6], out[-1][7] = place, partner, digest
        elif not out or place > out[-1][3]:
            out.append([doc, later, place, place, partner, digest, partner, digest])
    return out


def shared_runs(docs: DataFrame) -> DataFrame:
    """Runs of units in a row that other documents have too: ``doc_id, later, first, last`` and the ends' partners.

    A unit's partner is the smallest id that has it, for that document itself the largest. ``later``: a run of units that
    documents with smaller ids have; other runs take all shared units, and are left out where all are such.
    Digests are counted with map-side sums first; only those of several documents meet their occurrences again, in a join
    that adaptive execution splits where one digest is very frequent. What is gathered is one document's shared units.
    """
    found = unit_rows(docs)
    seen = found.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    met = found.join(seen, "digest").select("doc_id", "place", "digest", F.when(F.col("doc_id") > F.col("least"), F.col("least")).otherwise(F.col("most")).alias("partner"))
    held = met.groupBy("doc_id").agg(F.collect_list(F.struct("place", "digest", "partner")).alias("units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            rows = []
            for doc, shared in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shared.sort(key=lambda x: x["place"])
                later = [x for x in shared if x["partner"] < doc]
                rows += _chained(doc, True, later)
                if len(later) < len(shared):
                    rows += _chained(doc, False, shared)
            if rows:
                kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
                names = [x.split()[0] for x in _RUN.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return held.mapInArrow(run, _RUN)


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, digest, left_bytes, right_bytes``: what stands before and behind a unit of a document.

    The bytes of one chunk and of what decides on its cut are enough: if they were all the same on both sides, the cut and
    with it the next unit would be the same, and the run would go on.
    """
    asked = materialize(wanted.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("digest").alias("asked")), "asked")
    both = join_few(docs, asked, "_id", "inner").select("_id", "_text", "asked")
    more = WINDOW + REACH + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows = []
            for doc, text, asked in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = _bytes(text)
                cuts, digests = units(data)
                place = {d: k for k, d in reversed(list(enumerate(_signed(digests).tolist())))}
                for digest in asked:
                    k = place.get(digest)
                    if k is None:
                        continue  # of another row with this id
                    start, end, behind = cuts[k], cuts[min(k + 2, len(cuts) - 1)], cuts[min(k + 3, len(cuts) - 1)]
                    rows.append((doc, digest, data[max(0, cuts[max(k - 1, 0)] - more) : start], data[end : behind + more]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "digest", "left_bytes", "right_bytes"])

    found = both.mapInArrow(run, "doc_id long, digest long, left_bytes binary, right_bytes binary")
    return found.groupBy("doc_id", "digest").agg(F.max("left_bytes").alias("left_bytes"), F.max("right_bytes").alias("right_bytes"))


def passages(docs: DataFrame) -> DataFrame:
    """``_id, _runs``: for each document with shared units its runs and what stands around them in their partners."""
    runs = materialize(shared_runs(docs), "shared-runs")
    ends = [runs.select(F.col(f"{x}_doc").alias("doc_id"), F.col(f"{x}_digest").alias("digest")) for x in ("left", "right")]
    around = materialize(contexts(docs, ends[0].union(ends[1]).distinct()), "contexts")
    known = runs
    for x in ("left", "right"):
        side = around.select(F.col("doc_id").alias(f"{x}_doc"), F.col("digest").alias(f"{x}_digest"), F.col(f"{x}_bytes"))
        known = known.join(side, [f"{x}_doc", f"{x}_digest"], "left")
    return known.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("first", "last", "later", "left_digest", "right_digest", "left_bytes", "right_bytes")).alias("_runs"))


def _common_suffix(a: bytes, b: bytes) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[-1 - n] == b[-1 - n]:
        n += 1
    return n


def _common_prefix(a: bytes, b: bytes) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _own_copies(data: bytes, cuts: list[int], digests: list[int]) -> Iterator[tuple[int, int]]:
    """Spans of bytes that the text has at an earlier place already."""
    seen: dict[int, int] = {}
    last = len(cuts) - 1
    now = None
    for k, digest in enumerate([*digests, None]):
        source = seen.setdefault(digest, k) if digest is not None else k
        if now and source < k and source - k == now[2]:
            now[1] = k
            continue
        if now:
            a, b, shift = now
            start, end = cuts[a], cuts[min(b + 2, last)]
            left = _common_suffix(data[max(0, cuts[a + shift] - (start - cuts[a - 1]) - 64) : cuts[a + shift]], data[:start])
            right = _common_prefix(data[cuts[min(b + shift + 2, last)] : cuts[min(b + shift + 3, last)] + 64], data[end : end + 4096])
            yield start - left, end + right
        now = [k, k, source - k] if source < k else None


def _words(data: bytes) -> int:
    return len(data.split())


def _passages(data: bytes, spans: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """Spans cut back to whole words, of which each has enough; those that touch or overlap as one. The white space
    before a span stays, so that the words on either side remain apart."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        while 0 < start < end and not data[start - 1 : start].isspace() and not data[start : start + 1].isspace():
            start += 1
        while 0 < start < end and data[start : start + 1].isspace():
            start += 1
        while start < end < len(data) and not data[end - 1 : end].isspace() and not data[end : end + 1].isspace():
            end -= 1
        if _words(data[start:end]) < min_words:
            continue
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def cut_text(text: str | None, runs: list[dict] | None, min_words: int = MIN_WORDS) -> tuple[str, list[tuple[int, int]], int, int, int]:
    """The text without copied passages, these as spans of code points, the number of chunks and of those in such
    passages, and the words in passages that another document has, whether they go or stay."""
    data = _bytes(text)
    cuts, digests = units(data)
    n_chunks, last = len(cuts) - 1, len(cuts) - 1
    signed = _signed(digests).tolist() if runs else []
    gone, shared = list(_own_copies(data, cuts, digests)) if len(set(digests)) < len(digests) else [], []
    for run in runs or ():
        a, b = run["first"], run["last"]
        if b >= len(signed) or signed[a] != run["left_digest"] or signed[b] != run["right_digest"]:
            continue  # of another row with this id
        start, end = cuts[a], cuts[min(b + 2, last)]
        start -= _common_suffix(run["left_bytes"] or b"", data[:start])
        end += _common_prefix(run["right_bytes"] or b"", data[end : end + len(run["right_bytes"] or b"")])
        shared.append((start, end))
        if run["later"]:
            gone.append((start, end))
    shared, gone = _passages(data, shared, min_words), _passages(data, gone, min_words)
    shared_words = sum(_words(data[a:b]) for a, b in shared)
    kept, out, at, chars, n_copied = [], [], 0, 0, 0
    for start, end in gone:
        before, away = data[at:start].decode(), data[start:end].decode()
        kept.append(before)
        out.append((chars + len(before), chars + len(before) + len(away)))
        n_copied += sum(1 for x, y in zip(cuts, cuts[1:], strict=False) if start <= x and y <= end)
        chars, at = out[-1][1], end
    kept.append(data[at:].decode())
    return ("".join(kept) if out else text or ""), out, n_chunks, n_copied, shared_words


_CUT = "kept_text string, removed_spans array<struct<start: int, end: int>>, n_chunks long, n_copied long, shared_words long"


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with kept_text, removed_spans, n_chunks, n_copied and shared_words.

    ``removed_spans`` is an array of start and end in code points; ``n_copied`` counts the chunks inside them;
    ``shared_words`` the words in passages that another document has, removed or not, so that it marks the first
    occurrences too. Of a passage of ``min_words`` words or more the occurrence in the document with the smallest id
    stays, and of several in one document the first. Rows that share an id are one document and lose nothing to each
    other. Rows without an id are compared with themselves only. A null or empty text has no chunks. Columns of the input
    whose names are among the added ones are replaced; an empty table gives no rows. A passage whose bytes hold fewer
    than three cuts is not seen: 0.07 % of those of 51 words, and none that is longer than a few hundred bytes.
    """
    added = ["kept_text", "removed_spans", "n_chunks", "n_copied", "shared_words"]
    rest = [x for x in docs.columns if x not in added]
    row = F.struct(*[docs[x] for x in docs.columns])
    own = docs.select(row.alias("_row"), docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text"))
    runs = materialize(passages(own.select("_id", "_text").where("_id IS NOT NULL")), "passages")
    joined = join_few(own, runs, "_id")

    @F.pandas_udf(_CUT)
    def apply(texts, runs):
        import pandas as pd

        rows = [cut_text(t, None if r is None else list(r), min_words) for t, r in zip(texts, runs, strict=True)]
        spans = [[{"start": a, "end": b} for a, b in r[1]] for r in rows]
        return pd.DataFrame({"kept_text": [r[0] for r in rows], "removed_spans": spans, "n_chunks": [r[2] for r in rows], "n_copied": [r[3] for r in rows], "shared_words": [r[4] for r in rows]})

    # not deterministic, so that a filter on the result does not run it twice
    done = joined.withColumn("_cut", apply.asNondeterministic()("_text", "_runs"))
    return done.select(*[F.col(f"_row.`{x}`").alias(x) for x in rest], *[F.col(f"_cut.{x}").alias(x) for x in added])


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_substring_dedup(spark, sf_dir):
    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        "n_chunks",
        "n_copied",
        "shared_words",
        _written(F.col("removed_spans")).alias("removed_spans"),
        F.length("kept_text").cast("long").alias("kept_chars"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


def stage(docs: DataFrame) -> DataFrame:
    """The documents without copied passages; those of which nothing but white space is left go.

    A null text stays null. Rows that share an id are one document, as in ``dedup``.
    """
    done = dedup(docs)
    changed = F.size("removed_spans") > 0
    cut = done.withColumns({"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))})
    return cut.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
