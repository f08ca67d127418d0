"""SentencePiece encoding and decoding: the N best segmentations over the piece lattice.

A forward Viterbi pass gives the best score of each prefix. Backward from the end, A-star search extends partial
segmentations and ranks them by their own score plus the prefix's best score, which is exact: complete segmentations
leave the queue best first, and nothing is expanded that is not part of an answer or ties with one.

No piece continues from a visible character to the blank mark, so the lattice falls apart at such places and a text's
segmentations are combinations of its parts'. The best of a part, and how far its second falls short, are kept between
texts; only the few parts with the least shortfall can differ in the N best of a text.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

BLANK = "▁"
NBEST = 3
#: Bytes of the parts kept between texts, and of those kept with all their segmentations; beyond them a table is emptied.
KNOWN_BYTES, LISTED_BYTES = 400 << 20, 48 << 20
#: Bytes of a kept part beside its string and ids.
ENTRY = 132
#: Parts of more characters are searched on arrays instead of tuples.
LONG = 64
#: Scores that are no whole numbers count in these units.
UNIT = 1 << 20
_PARTS = re.compile(rf"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: Shortfall of a part that has one segmentation only.
NEVER = 1 << 62


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """Pieces of a model and their scores. A character that is no piece becomes its bytes, at the lowest score less 10.

    Scores are integers, so that sums are exact: the model's own if they are whole numbers, else in units of 1 / UNIT.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, int]] = {}
        self.byte_ids: dict[int, int] = {}
        self.bytes_of: list[bytes] = []
        lowest = 0
        scores = [model.get_score(k) for k in range(model.get_piece_size())]
        self.unit = 1 if all(float(x).is_integer() for x in scores) else UNIT
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)] = k
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k):
                self.bytes_of.append(b"")
            else:
                score = round(scores[k] * self.unit)
                self.pieces[piece] = (k, score)
                self.bytes_of.append(piece.replace(BLANK, " ").encode())
                lowest = min(lowest, score)
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("a piece of this model goes on past a blank mark")
        self.unknown = lowest - 10 * self.unit
        self._lengths = {k: len(p) for p, (k, _) in self.pieces.items()}
        self.starts = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        #: Id and score of each beginning of a piece, None if it is none itself.
        self.prefixes = {p: self.pieces.get(p) for p in self.starts}

    def edges(self, part: str) -> list[list[tuple[int, int, int]]]:
        """For each end in ``part`` the edges ``(id, start, score)`` that lead there; id -1 is a character's bytes."""
        n, pieces, starts = len(part), self.pieces, self.starts
        into: list[list[tuple[int, int, int]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            j = i + 1
            sub = part[i:j]
            if sub not in pieces:
                into[j].append((-1, i, self.unknown))
            while sub in starts:
                found = pieces.get(sub)
                if found:
                    into[j].append((found[0], i, found[1]))
                if j == n:
                    break
                j += 1
                sub = part[i:j]
        return into

    def forward(self, into) -> list[int]:
        best = [0] * len(into)
        for j in range(1, len(into)):
            best[j] = max(best[i] + s for _, i, s in into[j])
        return best

    def first(self, part: str) -> tuple[int, int, bytes]:
        """Score of the best segmentation, shortfall of the second, and the best one's packed ids.

        The second best is the best through some edge that the best does not use.
        """
        if len(part) > LONG:
            return self._first_long(part)
        n, known, unknown = len(part), self.prefixes.get, self.unknown
        best, by, origin = [-NEVER] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0
        edges: list[tuple[int, int, int]] = []
        add = edges.append
        for i in range(n):
            here, j = best[i], i + 1
            found = known(part[i], 0)
            if not found:  # no piece of one character
                add((i, j, unknown))
                if here + unknown > best[j]:
                    best[j], by[j], origin[j] = here + unknown, -1, i
                if found == 0:
                    continue
            while True:
                if found:
                    k, s = found
                    add((i, j, s))
                    s += here
                    # of equals the smallest id, so that ids read from the end come in order
                    if s > best[j] or s == best[j] and k < by[j]:
                        best[j], by[j], origin[j] = s, k, i
                if j == n:
                    break
                j += 1
                found = known(part[i:j], 0)
                if found == 0:
                    break
        ids: list[int] = []
        j = n
        while j:
            i = origin[j]
            ids.append(by[j] if by[j] >= 0 else -1 - ord(part[i]))
            origin[j] = ~i  # the edge from i to j is on the best path
            j = i
        rest = [-NEVER] * n + [0]
        second = -NEVER
        for i, j, s in reversed(edges):
            s += rest[j]
            if s > rest[i]:
                rest[i] = s
            if origin[j] != ~i and best[i] + s > second:
                second = best[i] + s
        return best[n], best[n] - second if second > -NEVER // 2 else NEVER, self.pack(ids[::-1])

    def pack(self, ids: list[int]) -> bytes:
        """Ids as packed unsigned 32-bit integers; ``-1 - c`` stands for the bytes of code point c."""
        out = array("I")
        for k in ids:
            if k >= 0:
                out.append(k)
            else:
                out.extend(self.byte_ids[b] for b in chr(-1 - k).encode())
        return out.tobytes()

    def _graph(self, part: str) -> tuple[np.ndarray, ...]:
        """Start, end, id and score of all edges of a part, in order of start, then length."""
        starts, ends, ids, scores = array("q"), array("q"), array("q"), array("q")
        known, n = self.prefixes.get, len(part)
        for i in range(n):
            found, j = known(part[i], 0), i + 1
            if not found:
                starts.append(i), ends.append(j), ids.append(-1), scores.append(self.unknown)
            while found != 0:
                if found:
                    starts.append(i), ends.append(j), ids.append(found[0]), scores.append(found[1])
                if j == n:
                    break
                j += 1
                found = known(part[i:j], 0)
        return tuple(np.frombuffer(x, np.int64) for x in (starts, ends, ids, scores))

    def _viterbi(self, n: int, graph: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Best score of each prefix, and the best edge into its end, of equals the one with the smallest id."""
        best, by = [-NEVER] * (n + 1), [-1] * (n + 1)
        best[0], kinds = 0, graph[2]
        for e, (i, j, s) in enumerate(zip(graph[0].tolist(), graph[1].tolist(), graph[3].tolist(), strict=True)):
            s += best[i]
            if s > best[j] or s == best[j] and kinds[e] < kinds[by[j]]:
                best[j], by[j] = s, e
        return np.array(best), np.array(by)

    @staticmethod
    def _path(by: np.ndarray, starts: np.ndarray, end: int) -> list[int]:
        """The best edges from ``end`` back to the start."""
        out, at, begin = [], end, starts.tolist()
        while at:
            e = int(by[at])
            out.append(e)
            at = begin[e]
        return out

    def _first_long(self, part: str) -> tuple[int, int, bytes]:
        two = self._nbest_long(part, 2)
        return two[0][0], two[0][0] - two[1][0] if len(two) > 1 else NEVER, two[0][1]

    def nbest(self, part: str, n: int) -> list[tuple[int, bytes]]:
        """Up to ``n`` pairs of score and packed ids, best first; equal scores by ids read from the end."""
        if len(part) > LONG:
            return self._nbest_long(part, n)
        into = self.edges(part)
        best = self.forward(into)
        queue: list[tuple[int, tuple[int, ...], int, int]] = [(-best[-1], (), len(part), 0)]
        out: list[tuple[int, bytes]] = []
        while queue and len(out) < n:
            _, back, j, own = heapq.heappop(queue)
            if not j:
                out.append((own, self.pack(self._named(part, back))))
                continue
            for k, i, s in into[j]:
                heapq.heappush(queue, (-(best[i] + s + own), (*back, k), i, own + s))
        return out

    def _nbest_long(self, part: str, n: int) -> list[tuple[int, bytes]]:
        """As ``nbest``, with a queue of complete paths instead of partial ones.

        Since the forward scores are exact, a partial path is known to go on along the best edges. So a path in the queue
        stands for all the partial ones on its way: what leaves it at an edge loses exactly that edge's shortfall. Of the
        ways to leave a path not more than ``n`` are needed, and none before the place where it left another itself.
        """
        graph = self._graph(part)
        starts, ends, ids, scores = graph
        best, by = self._viterbi(len(part), graph)
        loss = best[ends] - best[starts] - scores

        def entry(lost: int, path: list[int], left: int) -> tuple:
            return lost, (ids[path] + 1).astype(">u4").tobytes(), path, left

        queue = [entry(0, self._path(by, starts, len(part)), len(part))]
        out: list[tuple[int, bytes]] = []
        while queue and len(out) < n:
            queue.sort(key=lambda x: x[:2])
            lost, _, path, left = queue.pop(0)
            out.append((int(best[-1]) - lost, self.pack(self._named(part, tuple(ids[path].tolist())))))
            if len(out) == n:
                break
            used = np.full(len(part) + 1, -1)
            used[ends[path]] = path
            taken = used[ends]
            ways = np.flatnonzero((taken >= 0) & (taken != np.arange(len(ends))) & (ends <= left))
            least = np.sort(loss[ways])[: n - len(out)]
            ways = ways[loss[ways] <= (least[-1] if len(least) else -1)]
            smaller = ids[ways] < ids[taken[ways]]
            order = np.lexsort((ids[ways], np.where(smaller, -ends[ways], ends[ways]), ~smaller, loss[ways]))
            place = {int(ends[e]): k for k, e in enumerate(path)}
            for e in ways[order][: n - len(out)].tolist():
                before = path[: place[int(ends[e])]]
                queue.append(entry(lost + int(loss[e]), [*before, e, *self._path(by, starts, int(starts[e]))], int(starts[e])))
            queue = heapq.nsmallest(n - len(out), queue, key=lambda x: x[:2])
        return out

    def _named(self, part: str, back: tuple[int, ...]) -> list[int]:
        """Ids in reading order, the code point in place of each unknown."""
        ids, at = [], len(part)
        for k in back:
            at -= self._lengths[k] if k >= 0 else 1
            ids.append(k if k >= 0 else -1 - ord(part[at]))
        return ids[::-1]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes joined, blank marks as blanks, without the blank put before the text."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


class Encoder:
    def __init__(self, path: str, n: int = NBEST, known: int = KNOWN_BYTES):
        self.lattice, self.n, self._most = Lattice(path), n, known
        self._clear()

    def _clear(self) -> None:
        self._at: dict[str, int] = {}
        self._ids: list[bytes] = []
        self._scores, self._gaps = array("q"), array("q")
        self._lists: dict[str, list[tuple[int, bytes]]] = {}
        self._held = self._listed = 0

    def encode(self, text: str) -> list[tuple[int, bytes]]:
        """The ``n`` best segmentations of a whole text: score and packed ids.

        Equal scores are ordered by the ranks that the parts' segmentations have among their own, the last part's
        first.
        """
        if not text:
            return [(0, b"")]
        # Parts are named without their first blank mark; between single blanks they are just the words.
        if "  " in text or text[0] == " " or BLANK in text:
            parts = [x[1:] for x in _PARTS.findall(BLANK + text.replace(" ", BLANK))]
        else:
            parts = text.split(" ")
        if self._held > self._most:
            self._clear()
        for part in set(parts).difference(self._at):
            score, gap, ids = self.lattice.first(BLANK + part)
            self._at[part] = len(self._ids)
            self._ids.append(ids)
            self._scores.append(score)
            self._gaps.append(gap)
            self._held += ENTRY + getsizeof(part) + getsizeof(ids)
        at = np.fromiter(map(self._at.__getitem__, parts), np.int64, len(parts))
        total = int(np.frombuffer(self._scores, np.int64)[at].sum())
        gaps = np.frombuffer(self._gaps, np.int64)[at]
        ids = list(map(self._ids.__getitem__, at.tolist()))
        out = []
        for loss, choice in self._combined(parts, gaps):
            now = ids
            if choice:
                now = ids.copy()
                for place, other in choice:
                    now[place] = other
            out.append((total - loss, b"".join(now)))
        return out

    def _combined(self, parts: list[str], gaps: np.ndarray) -> list[tuple[int, list]]:
        few = self.n - 1
        if len(gaps) > few:  # the parts whose second is nearest, of equals the first
            bound = np.partition(gaps, few - 1)[few - 1] if few else -1
            places = np.flatnonzero(gaps <= bound)
            places = np.sort(places[np.argsort(gaps[places], kind="stable")[:few]])
        else:
            places = np.arange(len(gaps))
        best: list[tuple[int, tuple[int, ...], list]] = [(0, (), [])]
        for place in places.tolist():
            if gaps[place] == NEVER:
                continue
            part = parts[place]
            if part not in self._lists:
                if self._listed > LISTED_BYTES:
                    self._lists.clear()
                    self._listed = 0
                self._lists[part] = found = self.lattice.nbest(BLANK + part, self.n)
                self._listed += ENTRY + getsizeof(part) + sum(getsizeof(x) + ENTRY for _, x in found)
            found = self._lists[part]
            merged = [(loss + found[0][0] - s, (rank, *ranks), [*choice, (place, ids)] if rank else choice) for loss, ranks, choice in best for rank, (s, ids) in enumerate(found)]
            best = sorted(merged, key=lambda x: x[:2])[: self.n]
        return [(loss, choice) for loss, _, choice in best]


@lru_cache(maxsize=2)
def shared_encoder(path: str, n: int) -> Encoder:
    """One encoder for each worker process, so that later tasks there find the parts that earlier ones met."""
    return Encoder(path, n)


def encode_nbest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, n: int = NBEST) -> DataFrame:
    """``doc_id, rank, score, ids, decoded``: the ``n`` best segmentations of each whole text, fewer if there are fewer.

    ``ids`` holds packed little-endian unsigned 32-bit ids, ``decoded`` the text read back from them (a blank mark in a
    text comes back as a blank, as with the library). ``score`` counts in the model's units, see ``Lattice``. A null text counts as empty and has one segmentation, of no
    pieces; null and repeated ids are carried as they are; other columns are ignored; an empty table gives no rows.
    """
    path = model_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path, n)
        for batch in slices(batches, 128):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for rank, (score, ids) in enumerate(encoder.encode(text or ""), 1):
                    rows.append((doc, rank, score, ids, encoder.lattice.decode(np.frombuffer(ids, "<u4"))))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "rank", "score", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, rank int, score long, ids binary, decoded string")


def op10_nbest_pieces(spark, sf_dir):
    found = encode_nbest(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "rank", "score", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
