"""Words of many texts at once, on the UTF-8 bytes of an Arrow column.

A table of 256 entries says which bytes belong to words, differences of that mask give the words' ends, and checksums and
hashes advance over all words together, so that no text becomes a Python string.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Words longer than this are finished one by one.
LONG = 64


def members(*spans: tuple[int, int], but: bool = False) -> np.ndarray:
    """The byte table of the given spans (ends included), or of all bytes but those."""
    out = np.zeros(256, bool)
    for first, last in spans:
        out[first : last + 1] = True
    return out ^ but


#: Everything but the blanks U+0020 and U+0009 to U+000D; all bytes of longer characters are among them.
UNBLANK = members((0x20, 0x20), (0x09, 0x0D), but=True)
#: Digits, small letters and all bytes of characters beyond U+007F.
ALPHANUMERIC = members((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F), but=True)


@dataclass
class Words:
    """Word k of a column lies at ``data[starts[k]:ends[k]]``, in row ``row[k]``; rows and words are in order."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    rows: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


def scan(column: pa.Array, inside: np.ndarray) -> Words:
    """The words of a string column, A-Z in lower case; a null has none, and no word reaches over a row's end."""
    whole = pc.fill_null(column, "").cast(pa.large_string())
    _, bounds, buffer = whole.buffers()
    at = np.frombuffer(bounds, np.int64, len(whole) + 1, 8 * whole.offset)
    raw = np.frombuffer(buffer, np.uint8)[at[0] : at[-1]] if buffer is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    data = LOWER[raw]
    mask = inside[data]
    edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    first, last = ([0], [len(mask)]) if len(mask) else ([], [])
    edges = np.concatenate([first if len(mask) and mask[0] else [], edges, last if len(mask) and mask[-1] else []]).astype(np.int64)
    starts, ends = edges[::2], edges[1::2]
    cut = np.unique(at[(at > 0) & (at < len(mask))])
    cut = cut[mask[cut - 1] & mask[cut]] if len(cut) else cut  # rows that meet within a word
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return Words(data, starts, ends, np.searchsorted(at, starts, "right") - 1, len(whole))


def _crc_table() -> np.ndarray:
    """The CRC-32 remainder of each byte (polynomial 0xEDB88320, bits reversed)."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


CRC = _crc_table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of ``data``: one table step for all spans that still have a byte, longest first."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    begin, size = starts[order], length[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    left = len(size)
    for k in range(min(LONG, int(size[0]) if left else 0)):
        left = int(np.searchsorted(-size[:left], -k, "left"))  # spans of more than k bytes
        now = state[:left]
        state[:left] = CRC[(now ^ data[begin[:left] + k]) & 0xFF] ^ (now >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for k in range(int(np.searchsorted(-size, -LONG, "left"))):
        state[k] = zlib.crc32(data[begin[k] + LONG : begin[k] + size[k]].tobytes(), int(state[k]))
    out = np.empty_like(state)
    out[order] = state
    return out


_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A step of a 64-bit hash: one to one in ``value`` for a given state, and the other way round."""
    out = (state ^ value) * _STEP
    out ^= out >> np.uint64(29)
    out *= _TURN
    out ^= out >> np.uint64(32)
    return out


def hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes a step."""
    length = words.ends - words.starts
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(words.data) + 1, "<u8", padded.data, 0, (1,))
    out = length.astype(np.uint64) * _TURN
    todo, k = np.arange(len(length)), 0
    while len(todo):
        rest = np.minimum(length[todo] - 8 * k, 8).astype(np.uint64)
        chunk = eights[words.starts[todo] + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest))
        out[todo] = mixed(out[todo], chunk)
        k += 1
        todo = todo[length[todo] > 8 * k]
        if 8 * k >= LONG:
            break
    if len(todo):
        from xxhash import xxh64_intdigest

        out[todo] = [xxh64_intdigest(words.data[words.starts[w] : words.ends[w]].tobytes(), 1) for w in todo.tolist()]
    return out


def runs(words: Words, values: np.ndarray, n: int, *, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """``row, hash`` of each run of ``n`` words; with ``short``, a row of fewer words gives its whole sequence as one run."""
    counts = words.counts()
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    left = (first + counts)[words.row] - np.arange(len(values))  # words from here to the row's end
    full = np.flatnonzero(left >= n)

    def joined(at: np.ndarray, k: int) -> np.ndarray:
        out = np.full(len(at), k, np.uint64) * _STEP
        for i in range(k):
            out = mixed(out, values[at + i])
        return out

    rows, found = [words.row[full]], [joined(full, n)]
    for k in range(1, n) if short else ():
        at = np.flatnonzero(counts == k)
        rows.append(at)
        found.append(joined(first[at], k))
    return np.concatenate(rows), np.concatenate(found)
