"""Sum-of-squares online packing of tokenised documents into windows of fixed length.

Each task packs the documents of its own input partition and shares nothing with other tasks: no shuffle, no global
state, and a task that is run again replaces its whole output. Documents longer than a window fill whole windows
first; the rest is placed online into the fill level that minimises the sum of squared counts of partially filled
windows. When a partition ends, the windows still open are laid end to end and cut into full windows; the very last
one is cut at powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import slices, table

CAPACITY = 1024
#: Documents end with this id.
END_ID = 0
#: Sequences are numbered from the partition's number times this.
SEQUENCES_PER_PARTITION = 1 << 36


class SumOfSquares:
    """Windows of ``capacity``; ``levels[h]`` counts the open windows filled to ``h``."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, np.int64)
        self._open: list[list[list]] = [[] for _ in range(capacity)]

    def level_for(self, size: int) -> int:
        """The level (0: a new window) whose use leaves the smallest sum of squares; of equals, the fullest."""
        last = self.capacity - size
        now, then = self.levels[1 : last + 1], self.levels[1 + size : self.capacity + 1]
        # (now-1)^2 - now^2 + (then+1)^2 - then^2; a window that becomes full is no longer counted
        change = 2 * (then - now) + 2
        if len(change):
            change[-1] = 1 - 2 * now[-1]
            change = np.where(now > 0, change, np.iinfo(np.int64).max)
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[best] <= 2 * self.levels[size] + 1:
                return best + 1
        return 0

    def place(self, size: int, item) -> list | None:
        """Place an item of ``0 < size < capacity``; returns the items of the window if that fills it."""
        level = self.level_for(size)
        window = self._open[level].pop() if level else []
        if level:
            self.levels[level] -= 1
        window.append((size, item))
        if level + size == self.capacity:
            return window
        self.levels[level + size] += 1
        self._open[level + size].append(window)
        return None

    def drain(self) -> Iterator[list]:
        """The windows still open, fullest first."""
        for level in range(self.capacity - 1, 0, -1):
            yield from self._open[level]
            self._open[level] = []
        self.levels[:] = 0


def pieces(documents: Iterator[tuple[object, bytes]], capacity: int = CAPACITY, first: int = 0) -> Iterator[tuple]:
    """``(document, start, ids, doc_tokens, sequence, offset)`` for ``(document, packed ids)``, each id once."""
    packer, sequence = SumOfSquares(capacity), first

    def lay(items):
        offset = 0
        for size, (doc, start, ids, total) in items:
            yield doc, start, ids, total, sequence, offset
            offset += size

    for doc, ids in documents:
        total = len(ids) // 4
        whole = total // capacity * capacity
        for start in range(0, whole, capacity):
            yield doc, start, ids[4 * start : 4 * (start + capacity)], total, sequence, 0
            sequence += 1
        if total > whole and (full := packer.place(total - whole, (doc, whole, ids[4 * whole :], total))):
            yield from lay(full)
            sequence += 1

    room, items = capacity, []
    left = [x for window in packer.drain() for x in window]
    remaining = sum(size for size, _ in left)
    room = _room(remaining, capacity)
    for size, (doc, start, ids, total) in left:
        while size:
            take = min(size, room)
            items.append((take, (doc, start, ids[: 4 * take], total)))
            size, start, ids, room, remaining = size - take, start + take, ids[4 * take :], room - take, remaining - take
            if not room:
                yield from lay(items)
                sequence, items, room = sequence + 1, [], _room(remaining, capacity)


def _room(remaining: int, capacity: int) -> int:
    """A full window while enough is left, then the largest power of two that can be filled."""
    return capacity if remaining >= capacity else 1 << max(remaining.bit_length() - 1, 0)


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds packed little-endian unsigned 32-bit token ids. A null text counts as empty and becomes the closing
    id alone; a null or repeated id is carried as it is, each row being its own document; other columns are ignored;
    an empty table gives no rows. Very long texts fill several windows.
    """
    path = tokenizer_path or tokens.default_path()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.shared_encoder(path), np.array([end_id], "<u4").tobytes()
        partition = TaskContext.get().partitionId()

        def documents():
            for batch in slices(batches):
                texts = [x or "" for x in batch.column(1).to_pylist()]
                for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    yield doc, ids + end

        rows: list[tuple] = []
        for doc, start, ids, total, sequence, offset in pieces(documents(), capacity, partition * SEQUENCES_PER_PARTITION):
            rows.append((doc, start, len(ids) // 4, ids, total, sequence, offset))
            if len(rows) == 2048:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op6_packing(spark, sf_dir):
    return digest(pack(table(spark, sf_dir, "documents")))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
