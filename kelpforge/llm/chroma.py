"""Chroma audio fingerprints: recordings as sequences of packed integers, and their alignment.

A recording becomes frames of twelve pitch classes. Sixteen filters compare sums over rectangles of that image, which
an integral image gives in four reads; each is quantised to two bits of a Gray code, so that one 32-bit integer stands
for a frame. At each offset between two recordings every equal bit is a vote for it and every other bit one against. One bit
of each of 64 frames in a row, packed into one word, votes at every offset: this histogram names the offsets worth a look; the
bit errors over the whole overlap decide, and of the offsets within the limit the one with the most votes wins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, table

RATE = 4096
FRAME, HOP = 1024, 256
PITCHES = 12
#: Lowest and highest frequency that counts, in Hz.
BAND = (110.0, 1760.0)
#: Weights of neighbouring frames.
SMOOTH = np.array([1, 2, 3, 2, 1]) / 9
#: Filters: kind, first pitch class, pitch classes, frames. Kinds set against each other: halves in pitch, halves in
#: time, diagonal quarters, the middle third in pitch, the middle third in time.
FILTERS = [
    (0, 0, 12, 6), (0, 1, 8, 10), (0, 4, 6, 14), (0, 6, 6, 8), (1, 0, 12, 16), (1, 0, 4, 8), (1, 4, 4, 12), (1, 8, 4, 8),
    (2, 0, 12, 12), (2, 2, 8, 8), (2, 6, 6, 14), (3, 0, 12, 8), (3, 1, 9, 12), (4, 0, 12, 15), (4, 3, 6, 9), (4, 8, 3, 12),
]
WIDEST = max(x[3] for x in FILTERS)
GRAY = np.array([0, 1, 3, 2], np.uint32)

#: Recordings match if at the winning offset at most this share of bits differs, over at least so many frames. Neighbouring
#: frames are much alike: of pairs of unrelated recordings 3 in 1,000 match over 24 frames, a third of that for each 6
#: frames more, and about 2 in a million over 64, which are four seconds.
MAX_ERROR = 0.12
MIN_OVERLAP = 64
#: A window of so many frames votes with one bit a frame, each bit of the integers in turn; windows begin STRIDE frames apart. An
#: offset is looked at if in some window at most this share of the votes is wrong.
WINDOW, STRIDE, VOTE_ERROR = 64, 32, 0.26
#: Recordings longer than this go through transforms over all bits instead, which cost less there.
SHORT = 512
#: Recordings and queries are compared in blocks of about so many frames, and within a block so many sums at once.
BLOCK_FRAMES, QUERY_FRAMES = 65_536, 262_144
SUMS = 4_000_000
#: At most so many tasks compare blocks.
TASKS = 2000


@lru_cache
def _classes(rate: int) -> np.ndarray:
    """Share of each spectral line in each pitch class."""
    lines = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(lines), PITCHES))
    for k, f in enumerate(lines):
        if BAND[0] <= f <= BAND[1]:
            pitch = PITCHES * np.log2(f / 440)
            low = int(np.floor(pitch))
            out[k, low % PITCHES] += 1 - (pitch - low)
            out[k, (low + 1) % PITCHES] += pitch - low
    return out


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames of pitch-class strengths of length one (silence: zero)."""
    if len(samples) < FRAME:
        return np.zeros((0, PITCHES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((len(frames), PITCHES))
    window = np.hanning(FRAME)
    for start in range(0, len(frames), 512):
        out[start : start + 512] = np.abs(np.fft.rfft(frames[start : start + 512] * window)) ** 2 @ _classes(rate)
    if len(out) >= len(SMOOTH):
        out = np.stack([np.convolve(out[:, k], SMOOTH, "valid") for k in range(PITCHES)], axis=1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 1e-9, out / np.maximum(norm, 1e-9), 0.0)


def responses(image: np.ndarray) -> np.ndarray:
    """Each filter's value at each frame from which the widest filter fits."""
    n = len(image) - WIDEST + 1
    if n <= 0:
        return np.zeros((0, len(FILTERS)))
    total = np.zeros((len(image) + 1, PITCHES + 1))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)

    def area(t0, t1, p0, p1):
        return total[t1 : t1 + n, p1] - total[t0 : t0 + n, p1] - total[t1 : t1 + n, p0] + total[t0 : t0 + n, p0]

    out = np.empty((n, len(FILTERS)))
    for k, (kind, p, h, w) in enumerate(FILTERS):
        whole = area(0, w, p, p + h)
        if kind == 0:
            part = area(0, w, p, p + h // 2)
        elif kind == 1:
            part = area(0, w // 2, p, p + h)
        elif kind == 2:
            part = area(0, w // 2, p, p + h // 2) + area(w // 2, w, p + h // 2, p + h)
        elif kind == 3:
            part = area(0, w, p + h // 3, p + 2 * (h // 3))
        else:
            part = area(w // 3, 2 * (w // 3), p, p + h)
        out[:, k] = np.log((1 + part) / (1 + whole - part))
    return out


@lru_cache
def _levels() -> np.ndarray:
    """Quartiles of each filter over a fixed noise image, so that the four levels are about equally frequent."""
    noise = np.random.default_rng(7).lognormal(0, 2, (4000, PITCHES))
    noise = np.stack([np.convolve(noise[:, k], np.ones(4) / 4, "valid") for k in range(PITCHES)], axis=1)
    return np.quantile(responses(noise / np.linalg.norm(noise, axis=1, keepdims=True)), [0.25, 0.5, 0.75], axis=0)


def fingerprint_samples(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """One unsigned 32-bit integer for each frame (none for less than WIDEST frames)."""
    values = responses(chroma(np.asarray(samples, np.float64), rate))
    level = (values[:, None, :] > _levels()[None]).sum(axis=1)
    shifts = np.arange(0, 2 * len(FILTERS), 2, dtype=np.uint32)
    return np.bitwise_or.reduce(GRAY[level] << shifts, axis=1) if len(level) else np.zeros(0, np.uint32)


def pcm16(data: bytes) -> np.ndarray:
    """Samples of 16-bit little-endian mono PCM; a last odd byte is left out."""
    return np.frombuffer(data, "<i2", len(data) // 2) / 32768


def fingerprints(media: DataFrame, *, id_col: str, audio_col: str, rate: int = RATE, samples: Callable = pcm16) -> DataFrame:
    """``rec_id, ints``: the fingerprint of each row's audio, from the whole recording.

    ``samples`` turns the column's value into samples. Null or too short audio has an empty fingerprint; null and
    repeated ids are carried as they are; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            values = [[] if x is None else fingerprint_samples(samples(x), rate).view(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.int32()))], names=["rec_id", "ints"])

    return media.select(F.col(id_col).cast("long").alias("rec_id"), F.col(audio_col).alias("audio")).mapInArrow(run, "rec_id long, ints array<int>")


def _spectra(prints: list[np.ndarray], size: int) -> np.ndarray:
    """``frequency, recording, bit``: the transforms over time of each bit as 1 or -1; frames that are not there count 0."""
    out = np.zeros((len(prints), size, 32), np.float32)
    for k, x in enumerate(prints):
        out[k, : len(x)] = 1 - 2 * np.unpackbits(x.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1).astype(np.float32)
    return np.ascontiguousarray(np.fft.rfft(out, axis=1).astype(np.complex64).transpose(1, 0, 2))


def _size(frames: int) -> int:
    """The least length for a fast transform that holds so many frames."""
    return min(m << max(0, math.ceil(math.log2(frames / m))) for m in (2, 9, 10, 12, 14, 15))


def _errors(q_ints, r_ints, q_len, r_len, i, j, offset: int) -> Iterator[tuple[int, int, int, int]]:
    """``query, recording, overlap, bit errors`` of those of the pairs ``i, j`` that are within the limits at an offset."""
    first, end = max(0, offset), np.minimum(r_len[j], q_len[i] + offset)
    enough = end - first >= MIN_OVERLAP
    i, j, end = i[enough], j[enough], end[enough]
    if len(i):
        t = np.arange(first, int(end.max()))
        wrong = np.bitwise_count(r_ints[j][:, t] ^ q_ints[i][:, np.minimum(t - offset, q_ints.shape[1] - 1)])
        wrong[t[None, :] >= end[:, None]] = 0
        errors = wrong.sum(axis=1, dtype=np.int32)
        for k in np.flatnonzero(errors <= MAX_ERROR * 32 * (end - first)).tolist():
            yield int(i[k]), int(j[k]), int(end[k]) - first, int(errors[k])


def _words(ints: np.ndarray) -> np.ndarray:
    """For each recording and first frame the votes of the window there: bit k is that of frame k, at place k modulo 32."""
    out = np.zeros((len(ints), ints.shape[1] - WINDOW + 1), np.uint64)
    for k in range(WINDOW):
        out |= ((ints[:, k : k + out.shape[1]] >> np.uint32(k % 32)) & np.uint32(1)).astype(np.uint64) << np.uint64(k)
    return np.ascontiguousarray(out.T)


def _short_offsets(asked: list[np.ndarray], known: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """As ``offsets``, for short recordings in the order of their lengths: votes of windows at every offset, then all bits where few are wrong."""
    q_len, r_len = (np.array([len(x) for x in side]) for side in (asked, known))
    longest, widest = int(q_len.max()), int(r_len.max())

    def padded(prints, width):
        out = np.zeros((len(prints), width), np.uint32)
        for k, x in enumerate(prints):
            out[k, : len(x)] = x
        return out

    q_ints, r_ints = padded(asked, longest), padded(known, widest)
    left, right = _words(q_ints), _words(r_ints)
    best: dict[tuple[int, int], tuple] = {}
    for offset in range(MIN_OVERLAP - longest, widest - MIN_OVERLAP + 1):
        found = []
        for at in range(max(0, offset), min(widest, longest + offset) - WINDOW + 1, STRIDE):
            q, r = np.searchsorted(q_len, at - offset + WINDOW), np.searchsorted(r_len, at + WINDOW)  # those before end too early
            wrong = np.bitwise_count(left[at - offset, q:, None] ^ right[at, None, r:])
            near = np.flatnonzero(wrong <= int(VOTE_ERROR * WINDOW))
            found.append((near // wrong.shape[1] + q) * len(known) + near % wrong.shape[1] + r if len(near) else near)
        pairs = np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.zeros(0, np.int64)
        for start in range(0, len(pairs), 65_536):
            rows, cols = np.divmod(pairs[start : start + 65_536], len(known))
            for q, r, n, errors in _errors(q_ints, r_ints, q_len, r_len, rows, cols, offset):
                held = (32 * n - 2 * errors, -offset, n, errors)
                best[q, r] = max(held, best.get((q, r), held))
    for (q, r), (vote, back, n, errors) in best.items():
        yield q, r, -back, vote, n, errors


def offsets(asked: list[np.ndarray], known: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``query, recording, offset, votes, overlap, bit errors`` of each pair's best offset within the limits, by place.

    Short recordings vote with windows. For others votes at all offsets are a correlation, so that a product for each
    frequency gives them for all pairs; what comes near the limit is counted again bit by bit.
    """
    short_q, long_q = ([k for k, x in enumerate(asked) if MIN_OVERLAP <= len(x) <= SHORT], [k for k, x in enumerate(asked) if len(x) > SHORT])
    short, long = ([k for k, x in enumerate(known) if MIN_OVERLAP <= len(x) <= SHORT], [k for k, x in enumerate(known) if len(x) > SHORT])
    short, short_q = (sorted(x, key=lambda k: len(side[k])) for x, side in ((short, known), (short_q, asked)))
    for at in range(0, len(short), 1024):
        for q_at in range(0, len(short_q), 512):
            rows, cols = short_q[q_at : q_at + 512], short[at : at + 1024]
            for q, r, *rest in _short_offsets([asked[k] for k in rows], [known[k] for k in cols]):
                yield rows[q], cols[r], *rest
    for rows, cols in ((short_q, long), (long_q, short + long)):
        for q, r, *rest in _all_offsets([asked[k] for k in rows], [known[k] for k in cols]) if rows and cols else ():
            yield rows[q], cols[r], *rest


def _all_offsets(asked: list[np.ndarray], known: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int, int]]:
    q_order, order = (sorted(range(len(x)), key=lambda k: len(x[k])) for x in (asked, known))
    at, end = 0, len(order)
    while at < end:
        longest = len(asked[q_order[-1]]) + len(known[order[min(at + 255, end - 1)]])
        part = order[at : at + max(1, min(256, SUMS // (64 * longest)))]
        at += len(part)
        size = _size(len(asked[q_order[-1]]) + len(known[part[-1]]) - 1)
        right = _spectra([known[k] for k in part], size).transpose(0, 2, 1)
        step = max(1, min(64, SUMS // (size * len(part))))
        n = np.array([len(known[k]) for k in part])
        shift = np.arange(size)
        shift = np.where(shift < n.max(), shift, shift - size)
        for start in range(0, len(q_order), step):
            rows = q_order[start : start + step]
            votes = np.fft.irfft(_spectra([asked[k] for k in rows], size).conj() @ right, size, axis=0)
            m = np.array([len(asked[k]) for k in rows])
            overlap = np.minimum(n[None, None, :], m[None, :, None] + shift[:, None, None]) - np.maximum(shift, 0)[:, None, None]
            near = (overlap >= MIN_OVERLAP) & (votes >= 32 * (1 - 2 * MAX_ERROR) * overlap - 1)
            best: dict[tuple[int, int], tuple] = {}
            for s, i, j in zip(*np.nonzero(near), strict=True):
                q, r, offset, length = rows[i], part[j], int(shift[s]), int(overlap[s, i, j])
                a, b = max(offset, 0), max(-offset, 0)
                errors = int(np.bitwise_count(known[r][a : a + length] ^ asked[q][b : b + length]).sum())
                if errors <= MAX_ERROR * 32 * length:
                    found = (32 * length - 2 * errors, -offset, length, errors)
                    best[q, r] = max(found, best.get((q, r), found))
            for (q, r), (vote, back, length, errors) in best.items():
                yield q, r, -back, vote, length, errors


def _blocks(classes: DataFrame, name: str, most: int) -> tuple[DataFrame, int]:
    """Classes in blocks of about ``most`` frames, a row each, and their number."""
    frames = classes.agg(F.coalesce(F.sum(F.size("ints")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, math.ceil(frames / most))
    held = classes.groupBy(F.pmod(F.xxhash64("class", F.lit(3)), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("class", "ints")).alias("all"))
    columns = {"class": F.transform("all", lambda x: x["class"]), "size": F.transform("all", lambda x: F.size(x["ints"])), "ints": F.flatten(F.transform("all", lambda x: x["ints"]))}
    return materialize(held.select(*[v.alias(f"{name}_{k}") for k, v in columns.items()]), f"{name}-blocks"), n


def align(queries: DataFrame, recordings: DataFrame) -> DataFrame:
    """``query_id, rec_id, offset, votes, overlap, bit_errors, error_rate`` of each matching pair of different ids.

    Both take ``rec_id, ints``. Frame t of the recording is heard at frame t - offset of the query. Equal fingerprints
    are one class and aligned once. Every class of the queries is compared with every class of the recordings at every offset,
    block by block, so that no match depends on how often an integer occurs. Of recordings of up to SHORT frames a window
    votes first, with a bit a frame: a match is lost if each of its windows has over VOTE_ERROR of these wrong, which of matches
    at the limit of MAX_ERROR happens to few in a thousand. ``votes`` are equal less different bits; of an offset's ties the least
    wins. Rows without an id or a fingerprint match nothing, nor do recordings of under MIN_OVERLAP frames; repeated rows match once.
    """
    known = materialize(recordings.where("rec_id IS NOT NULL AND size(ints) > 0").select("rec_id", "ints", F.xxhash64("ints").alias("class")).distinct(), "recordings")
    asked = materialize(queries.where("rec_id IS NOT NULL AND size(ints) > 0").select("rec_id", "ints", F.xxhash64("ints").alias("class")).distinct(), "queries")
    left, n_left = _blocks(asked.dropDuplicates(["class"]), "q", QUERY_FRAMES)
    right, n_right = _blocks(known.dropDuplicates(["class"]), "r", BLOCK_FRAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            q_class, q_size, q_ints, r_class, r_size, r_ints = (x[0].values.to_numpy() for x in batch.columns)
            if not len(q_class) or not len(r_class):
                continue
            asked, known = (np.split(np.ascontiguousarray(x).view(np.uint32), np.cumsum(n)[:-1]) for x, n in ((q_ints, q_size), (r_ints, r_size)))
            found = np.array(list(offsets(asked, known)), np.int64).reshape(-1, 6)
            ids = [pa.array(q_class[found[:, 0]], pa.int64()), pa.array(r_class[found[:, 1]], pa.int64())]
            yield pa.RecordBatch.from_arrays([*ids, *[pa.array(found[:, k].astype(np.int32)) for k in (2, 3, 4, 5)]], names=["q_class", "class", "offset", "votes", "overlap", "bit_errors"])

    schema = "q_class long, class long, offset int, votes int, overlap int, bit_errors int"
    judged = left.crossJoin(right).repartition(min(TASKS, n_left * n_right)).mapInArrow(run, schema)
    judged = judged.withColumn("error_rate", F.col("bit_errors") / (32.0 * F.col("overlap")))
    named = judged.join(asked.select(F.col("rec_id").alias("query_id"), F.col("class").alias("q_class")), "q_class").join(known.select("rec_id", "class"), "class")
    return named.where("query_id <> rec_id").select("query_id", "rec_id", "offset", "votes", "overlap", "bit_errors", "error_rate")


NOTE = 512


@lru_cache
def _tones() -> np.ndarray:
    t = np.arange(NOTE) / RATE
    return np.sin(2 * np.pi * 440 * 2 ** (np.arange(PITCHES)[:, None] / PITCHES) * t)


def rendered(vector: list[float]) -> np.ndarray:
    """A vector as a recording: note k sounds the twelve pitch classes as loud as components k to k + 11 say."""
    values = np.nan_to_num(np.asarray([x or 0.0 for x in vector], np.float64))
    if len(values) < PITCHES:
        return np.zeros(0)
    values = values / max(values.std(), 1e-9)
    return (np.exp(np.clip(np.lib.stride_tricks.sliding_window_view(values, PITCHES), -4, 4)) @ _tones()).ravel()


#: Every tenth recording is quoted by the one so many ids after it, with noise of this share of its loudness.
QUOTED, NOISE = 5, 0.02


def quoting(row: dict) -> np.ndarray:
    """A recording ``own`` and after it, if there is one, a quotation with noise that depends on the id."""
    own, quote = rendered(row["own"] or []), rendered(row["quote"] or [])
    if not len(quote):
        return own
    return np.concatenate([own, quote + np.random.default_rng(row["id"]).normal(0, NOISE * quote.std(), len(quote))])


def recordings(vectors: DataFrame) -> DataFrame:
    """``vec_id, audio``: what ``quoting`` renders for each row. An id that occurs several times is quoted by its least vector."""
    quotes = vectors.where("vec_id % 10 = 0").groupBy((F.col("vec_id") + QUOTED).alias("vec_id")).agg(F.min("embedding").alias("quote"))
    joined = vectors.select("vec_id", "embedding").join(quotes, "vec_id", "left")
    return joined.select("vec_id", F.struct(F.col("vec_id").alias("id"), F.col("embedding").alias("own"), "quote").alias("audio"))


def op2_chroma_alignment(spark, sf_dir):
    """The tables hold no audio: each embedding is rendered as a recording, every tenth is quoted by another with
    noise, and every twentieth is looked for in all.

    One row for each query: its number of links, the smallest id among itself and its matches, the best match (fewest
    errors a frame, then the smallest id) with its offset, overlap and errors, and the sum of the hashes of all pairs
    ``rec_id, offset, bit_errors``, which stands for the whole list. ``align`` gives the pairs themselves.
    """
    marked = materialize(fingerprints(recordings(table(spark, sf_dir, "embeddings")), id_col="vec_id", audio_col="audio", samples=quoting), "chroma")
    queries = marked.where("rec_id % 20 = 0")
    order = F.struct("error_rate", "rec_id", "offset", "overlap", "bit_errors")
    each = F.xxhash64("rec_id", "offset", "bit_errors").cast("decimal(38,0)")
    found = align(queries, marked).groupBy("query_id").agg(F.count("*").alias("n"), F.min("rec_id").alias("least"), F.min(order).alias("best"), F.sum(each).alias("pairs"))
    listed = queries.select(F.col("rec_id").alias("query_id"), F.size("ints").alias("n_frames")).join(found, "query_id", "left")
    best = [F.col(f"best.{x}").alias(y) for x, y in (("rec_id", "best_id"), ("offset", "best_offset"), ("overlap", "best_overlap"), ("bit_errors", "best_errors"))]
    return listed.select("query_id", "n_frames", F.coalesce("n", F.lit(0)).alias("n_matches"), F.least("query_id", "least").alias("class_id"), *best, F.coalesce("pairs", F.lit(0)).cast("string").alias("pairs_sum"))
