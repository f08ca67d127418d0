"""Chat formatting: conversations as token ids with a loss mask.

Every segment is encoded alone; the ids of control strings are reserved, lie beyond the vocabulary and are spliced in
between. The mask comes from prefix sums over the segments' lengths. Control strings that occur in a text are escaped
first, so that the formatted text, too, can be read back without doubt.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import slices, table

#: Control strings; the reserved id of each is its place here, from RESERVED on.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
RESERVED = 1 << 20
BEGIN, END, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, ROLE_END = range(RESERVED, RESERVED + len(CONTROLS))

#: A control string with any number of escapes after its first letter. No control string overlaps another, so the
#: matches of a text and of its escaped form are the same places.
_MARKED = re.compile("|".join(rf"({re.escape(c[0])})(\\*)({re.escape(c[1:])})" for c in CONTROLS))


def _marks(change: int):
    def one(m: re.Match) -> str:
        head, escapes, rest = (x for x in m.groups() if x is not None)
        return head + "\\" * max(len(escapes) + change, 0) + rest

    return one


def escape(text: str) -> str:
    """One escape more in each control string: none is left as it was."""
    return _MARKED.sub(_marks(1), text)


def unescape(text: str) -> str:
    return _MARKED.sub(_marks(-1), text)


def segments(role: str, text: str) -> list[tuple[int | str, bool]]:
    """Reserved ids and escaped texts of a turn, and whether the loss counts them."""
    if role == "user":
        return [(USER, False), (escape(text), False), (USER_END, False)]
    if role == "assistant":
        return [(escape(text), True), (END, False)]
    if role == "system":
        return [(SYSTEM, False), (escape(text), False), (SYSTEM_END, False)]
    return [(ROLE, False), (escape(role), False), (ROLE, False), (escape(text), False), (ROLE_END, False)]


def assemble(parts: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of encoded segments: the mask is the running sum of +1 and -1 at the ends of counted ones."""
    ids = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, "<u4")
    ends = np.cumsum([len(x) for x, _ in parts])
    steps = np.zeros(len(ids) + 1, np.int32)
    for (part, counted), end in zip(parts, ends, strict=True):
        if counted:
            steps[end - len(part)] += 1
            steps[end] -= 1
    return ids, np.cumsum(steps[:-1]).astype(np.uint8)


class Reader:
    """Reads formatted ids back."""

    def __init__(self, path: str):
        self._bytes = tokens.id_bytes(path)

    def text(self, ids: np.ndarray) -> str:
        return b"".join([self._bytes[x] for x in ids.tolist()]).decode("utf-8")

    def formatted(self, ids: np.ndarray) -> str:
        return "".join(CONTROLS[x - RESERVED] if isinstance(x, int) else x for x in self._items(ids))

    def _items(self, ids: np.ndarray) -> list[int | str]:
        """Reserved ids, and the texts between them (also empty ones)."""
        at = np.flatnonzero(ids >= RESERVED)
        out: list[int | str] = []
        last = 0
        for k in at.tolist():
            out += [self.text(ids[last:k]), int(ids[k])]
            last = k + 1
        return [*out, self.text(ids[last:])]

    def turns(self, ids: np.ndarray) -> list[tuple[str, str]]:
        items = self._items(ids)
        assert items[:2] == ["", BEGIN]
        out, k = [], 2
        while k + 1 < len(items):
            text, mark = items[k], items[k + 1]
            if mark == END:
                out.append(("assistant", text))
                k += 2
            elif mark == ROLE:
                out.append((items[k + 2], items[k + 4]))
                k += 6
            else:
                out.append(("user" if mark == USER else "system", items[k + 2]))
                k += 4
        return [(unescape(role), unescape(text)) for role, text in out]

    def under(self, ids: np.ndarray, mask: np.ndarray) -> str:
        """The unescaped text of each run under the mask, joined."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(np.int8)))
        return "".join(unescape(self.text(ids[a:b])) for a, b in edges.reshape(-1, 2).tolist())


def format_chats(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """``conv_id, n_turns, ids, loss_mask``: one row for each conversation, its turns in order.

    ``ids`` holds packed little-endian unsigned 32-bit ids, ``loss_mask`` one byte for each. Null roles and texts count
    as empty, a null turn comes first, equal turns by role and text, repeated rows are all kept, rows without a
    conversation form one of their own; other columns are ignored; an empty table gives no rows. Turns are sorted
    within partitions dealt by conversation and streamed through: a task holds one conversation's ids at a time.
    """
    path = tokenizer_path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.shared_encoder(path)
        now, n, parts = None, 0, []

        def done():
            ids, mask = assemble(parts)
            columns = [pa.array([now], pa.int64()), pa.array([n], pa.int64()), pa.array([ids.tobytes()]), pa.array([mask.tobytes()])]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "ids", "loss_mask"])

        for batch in slices(batches):
            conv, roles, texts = (batch.column(k).to_pylist() for k in (0, 2, 3))
            cut = [segments(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
            encoded = iter(encoder.encode([x for turn in cut for x, _ in turn if isinstance(x, str)]))
            for c, turn in zip(conv, cut, strict=True):
                if not parts or c != now:
                    if parts:
                        yield done()
                    now, n, parts = c, 0, [(np.array([BEGIN], "<u4"), False)]
                n += 1
                parts += [(np.frombuffer(next(encoded), "<u4") if isinstance(x, str) else np.array([x], "<u4"), counted) for x, counted in turn]
        if parts:
            yield done()

    picked = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    dealt = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return dealt.mapInArrow(run, "conv_id long, n_turns long, ids binary, loss_mask binary")


def read_back(formatted: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """What the contract asks of each formatted conversation, from its ids and mask alone."""
    path = tokenizer_path or tokens.default_path()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(path)
        for batch in slices(batches, 128):
            rows = []
            for conv, packed, mask in zip(*[batch.column(k).to_pylist() for k in (0, 2, 3)], strict=True):
                ids = np.frombuffer(packed, "<u4")
                turns, loss = reader.turns(ids), reader.under(ids, np.frombuffer(mask, np.uint8))
                written = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((conv, len(turns), hashlib.sha256(written.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(reader.formatted(ids))))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the query adds.
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chats(rows.union(spark.createDataFrame(ADDED, rows.schema))))


_SQL_MARKED = r"<\\*(?:s>|/s>|<SYS>>|</SYS>>)|\[\\*(?:INST\]|/INST\]|ROLE\]|/ROLE\])"

OP1_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_SQL_MARKED}'))
  + CASE role WHEN 'user' THEN length('[INST][/INST]') WHEN 'assistant' THEN length('</s>') WHEN 'system' THEN length('<<SYS>><</SYS>>')
    ELSE length('[ROLE][ROLE][/ROLE]') + length(role) + len(regexp_extract_all(role, '{_SQL_MARKED}')) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (length('<s>') + sum(chars))::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""
