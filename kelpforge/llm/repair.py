"""Conversation structure repair: the cheapest edits that make a conversation alternate.

A conversation is repaired when its roles' initials read ``(s?(ua)+)?``. The edits between two rows are one macro: a run of
insertions and what becomes of the next row. Macros have codes (``D``, ``ID``, ``IID``, ``IIK`` ... ``R``) of which none
begins another, so that of two equally cheap beginnings the one that reads lower is told by comparing the rank of what it
continues, then the code. Each layer of the dynamic programme thus keeps four states with cost, rank and one byte of
parent, whatever the length of the edits so far; the edits are read off the parents at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, table
from .resample import SQL_CRC_TABLE, sql_crc

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: States: nothing written, after a system row, after a user row, after an assistant row. A repair ends in the first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an insertion: what is inserted is what may come next.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = ("", "system", "user", "assistant")
#: More insertions than this come back to a state that fewer reach.
LONGEST_RUN = 2
#: Macro codes in the order of their letters.
CODES = sorted("I" * k + x for k, x in product(range(LONGEST_RUN + 1), "DKR"))
#: What is wrong with a row.
SOUND, BLANK, DUPLICATE, CUT = range(4)


def _moves(initial: str, fault: int) -> list[tuple[int, int, int, int]]:
    """``state before, state after, code, cost`` of each macro that ends with a row of that initial and fault."""
    out = []
    for before, run in product(range(4), range(LONGEST_RUN + 1)):
        state = before
        for _ in range(run):
            state = NEXT[state]
        put = lambda after, letter, cost: out.append((before, after, CODES.index("I" * run + letter), cost + INSERT * run))  # noqa: B023, E731
        put(state, "D", DELETE)
        if fault in (SOUND, CUT):
            extra = TRUNCATED if fault == CUT else 0
            own = {"s": SYSTEM if state == START else None, "u": USER if NEXT[state] == USER else None, "a": ASSISTANT if NEXT[state] == ASSISTANT else None}.get(initial)
            if own is not None:
                put(own, "K", extra)
            put(NEXT[state], "R", REROLE + extra)
    return out


MOVES = {(initial, fault): _moves(initial, fault) for initial in ("s", "u", "a", "") for fault in range(4)}


class Repair:
    """The dynamic programme of one conversation, fed row by row.

    Besides cost and rank each state has the running digest of its repaired text, so that texts are not kept.
    """

    def __init__(self):
        self.layer = {START: (0, 0, hashlib.sha256())}
        self.parents = bytearray()
        self.rows = 0

    def add(self, initial: str, fault: int, role: bytes, text: bytes) -> None:
        best: dict[int, tuple[int, int, int, int]] = {}
        for before, after, code, cost in MOVES[initial if initial in ("s", "u", "a") else "", fault]:
            held = self.layer.get(before)
            if held is not None:
                found = (held[0] + cost, held[1], code, before)
                if after not in best or found < best[after]:
                    best[after] = found
        order = sorted(best, key=lambda x: best[x][1:3])  # of strings: the beginning's rank, then the code
        step, layer = bytearray(4), {}
        for rank, after in enumerate(order):
            cost, _, code, before = best[after]
            layer[after] = (cost, rank, self._written(before, CODES[code], role, text))
            step[after] = before * len(CODES) + code
        self.layer = layer
        self.parents += step
        self.rows += 1

    def _written(self, state: int, code: str, role: bytes, text: bytes):
        digest = self.layer[state][2]
        if code in ("", "D"):
            return digest
        digest = digest.copy()
        for letter in code:
            if letter == "D":
                break
            if state != START:
                digest.update(b"\n")
            if letter == "I":
                state = NEXT[state]
                digest.update(NAMES[state].encode() + b":")
            else:
                digest.update(role if letter == "K" else NAMES[NEXT[state]].encode())
                digest.update(b":")
                digest.update(text)
        return digest

    def result(self) -> tuple[int, str, str]:
        """Cost, edits and the digest of the repaired text."""
        found = None
        for state, (cost, rank, _) in self.layer.items():
            end = state
            for run in range(LONGEST_RUN + 1):
                if end in (START, ASSISTANT):
                    found = min(found or (1 << 62, 0, 0, 0), (cost + INSERT * run, rank, run, state))
                end = NEXT[end]
        cost, _, run, state = found
        digest = self._written(state, "I" * run, b"", b"")
        codes = ["I" * run]
        for k in range(self.rows - 1, -1, -1):
            before, code = divmod(self.parents[4 * k + state], len(CODES))
            codes.append(CODES[code])
            state = before
        return cost, "".join(reversed(codes)), digest.hexdigest()


def numbered(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, fault, seen``, each conversation in one partition and in order.

    Rows come by turn (nulls first), then role, then text; null roles and texts count as one space. A fault is the first
    that holds: blank, duplicate (role and text of an earlier row), cut (the last character is not one of ``.!?``).
    ``seen`` numbers the rows of equal role and text.
    """
    space = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    picked = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    # one shuffle: the window below and the order after it lie within the partitions of the conversations
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn"))
    marked = picked.repartition("conv_id").withColumn("seen", seen)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("seen") > 1, DUPLICATE).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(SOUND)
    return marked.withColumn("fault", fault).sortWithinPartitions("conv_id", "turn", "role", "text", "seen")


REPAIRS = "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repairs(rows: DataFrame, **columns: str) -> DataFrame:
    """One row for each conversation of ``rows``: its faults, the cheapest edits and what they come to.

    ``audit`` holds a letter an edit, in order: Keep, Delete, Rerole, Insert; of equally cheap edits the one that reads
    lower. ``repaired_sha256`` is the digest of the repaired rows ``role:text``, joined by newlines; ``gaps`` are turns missing
    between the least and the largest; ``illegal`` counts neighbours whose initials are not su, ua or au. Rows without a
    conversation form one of their own; an empty role has no initial and cannot be kept; repeated rows are duplicates;
    other columns are ignored; an empty table gives no rows. Digest and edits are one value a conversation, so its rows pass
    through one task, as a sorted stream: in memory are four states, and four bytes a row for the edits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, work = None, None

        def done():
            conv, turns, faults, illegal, _, repair = work
            first, last, distinct = turns
            cost, audit, digest = repair.result()
            gaps = 0 if first is None else last - first + 1 - distinct
            values = [conv, repair.rows, gaps, *faults[1:], illegal, cost, audit, digest]
            return pa.RecordBatch.from_pylist([dict(zip(names, values, strict=True))], schema=schema)

        names = [x.split()[0] for x in REPAIRS.split(", ")]
        schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in REPAIRS.split(", ")])
        for batch in slices(batches):
            for conv, turn, role, text, fault in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "fault")], strict=True):
                if work is None or conv != now:
                    if work is not None:
                        yield done()
                    now, work = conv, [conv, [None, None, 0], [0, 0, 0, 0], 0, None, Repair()]
                turns = work[1]
                if turn is not None and turn != turns[1]:
                    turns[:] = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                work[2][fault] += 1
                if work[4] is not None and work[4] + role[:1] not in ("su", "ua", "au"):
                    work[3] += 1
                work[4] = role[:1]
                work[5].add(role[:1], fault, role.encode(), text.encode())
        if work is not None:
            yield done()

    return numbered(rows, **columns).mapInArrow(run, REPAIRS)


def repaired(rows: DataFrame, **columns: str) -> DataFrame:
    """``conv_id, place, role, text, edit``: the rows of the repaired conversations, numbered from 0.

    ``edit`` tells what was done: K, R or I. The edits of ``repairs`` are laid beside the rows by their number, so that
    this join deals a long conversation over all tasks.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "seen")
    placed = numbered(rows, **columns).select("conv_id", "role", "text", F.row_number().over(order).alias("_row"))
    audits = materialize(repairs(rows, **columns).select("conv_id", "audit"), "audits")
    letters = audits.select("conv_id", F.posexplode(F.split("audit", "")).alias("_at", "edit")).where("edit <> ''")
    before = Window.partitionBy("conv_id").orderBy("_at")
    counted = letters.select("conv_id", "edit", F.sum((F.col("edit") != "I").cast("long")).over(before).alias("_used"), F.sum((F.col("edit") != "D").cast("long")).over(before).alias("_out"))
    edits = counted.where("edit <> 'D'").withColumn("_row", F.when(F.col("edit") != "I", F.col("_used")))
    joined = edits.join(placed, edits["conv_id"].eqNullSafe(placed["conv_id"]) & (edits["_row"] == placed["_row"]), "left").select(edits["conv_id"], (F.col("_out") - 1).alias("place"), "role", F.coalesce("text", F.lit("")).alias("text"), "edit")
    # a kept system row comes first and shifts the others by one
    system = joined.where("place = 0 AND edit = 'K' AND role LIKE 's%'").select(F.col("conv_id").alias("_conv"), F.lit(1).alias("_system"))
    both = joined.join(system, joined["conv_id"].eqNullSafe(system["_conv"]), "left")
    due = F.when((F.col("place") - F.coalesce("_system", F.lit(0))) % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
    return both.select("conv_id", "place", F.when(F.col("edit") == "K", F.col("role")).otherwise(due).alias("role"), "text", "edit")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows ``conv_id, turn, role, text`` after the damage that the query plans for them.

    By the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4
    makes it a user's. A null is one space in that key, as a role and as a text.
    """
    space = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    marked = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text: Column = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role: Column = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def op11_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ids = rows.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    found = repairs(damaged(rows))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    zeros = [F.coalesce(x, F.lit(0)).alias(x) for x in counts]
    none = F.lit(hashlib.sha256().hexdigest())
    joined = ids.join(found, ids["_id"].eqNullSafe(found["conv_id"]), "left")
    return joined.select(F.col("_id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))


#: The macros as rows of SQL: initial, fault, state before and after, edits, cost; and the insertions at the end.
_SQL_MOVES = ", ".join(f"('{initial}', {fault}, {a}, {b}, '{CODES[code]}', {cost})" for (initial, fault), moves in MOVES.items() for a, b, code, cost in moves)
_SQL_ENDS = f"({START}, '', 0), ({SYSTEM}, 'II', {2 * INSERT}), ({USER}, 'I', {INSERT}), ({ASSISTANT}, '', 0)"

OP11_SQL = rf"""
WITH RECURSIVE {SQL_CRC_TABLE},
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
kinds AS (SELECT * EXCLUDE (h), {sql_crc("h")} % 20 AS kind FROM keyed, crc),
rows_ AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds WHERE kind <> 0)),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM rows_),
r AS (SELECT *, row_number() OVER w AS i, substr(role, 1, 1) AS own,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN {BLANK} WHEN seen > 1 THEN {DUPLICATE}
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN {CUT} ELSE {SOUND} END AS fault,
    lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) AS pair
  FROM seen WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen)),
moves(initial, fault, a, b, code, cost) AS (VALUES {_SQL_MOVES}),
ends(a, code, cost) AS (VALUES {_SQL_ENDS}),
convs AS (SELECT DISTINCT conv_id FROM conversations),
dp AS (SELECT conv_id, 0::BIGINT AS i, {START} AS state, {{'cost': 0, 'audit': ''}} AS best FROM convs
  UNION ALL SELECT dp.conv_id, r.i, b, min({{'cost': best.cost + moves.cost, 'audit': best.audit || code}})
  FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1
  JOIN moves ON a = state AND moves.fault = r.fault AND initial = CASE WHEN own IN ('s', 'u', 'a') THEN own ELSE '' END
  GROUP BY dp.conv_id, r.i, b),
n AS (SELECT conv_id, max(i) AS i FROM dp GROUP BY conv_id),
done AS (SELECT dp.conv_id, min({{'cost': best.cost + ends.cost, 'audit': best.audit || code}}) AS best
  FROM dp JOIN n USING (i) JOIN ends ON a = state WHERE n.conv_id IS NOT DISTINCT FROM dp.conv_id GROUP BY dp.conv_id),
letters AS (SELECT conv_id, generate_subscripts(string_split(best.audit, ''), 1) AS p, unnest(string_split(best.audit, '')) AS edit FROM done WHERE best.audit <> ''),
laid AS (SELECT *, sum((edit <> 'I')::INT) OVER w AS used, sum((edit <> 'D')::INT) OVER w AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
met AS (SELECT l.conv_id, p, edit, place, role, coalesce(text, '') AS text FROM laid AS l
  LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.used AND edit <> 'I' WHERE edit <> 'D'),
turned AS (SELECT conv_id, p, text, CASE WHEN edit = 'K' THEN role
    WHEN (place - max((place = 1 AND edit = 'K' AND role LIKE 's%')::INT) OVER (PARTITION BY conv_id)) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role FROM met),
texts AS (SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY p) AS body FROM turned GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = {BLANK}) AS blank,
  count(*) FILTER (fault = {DUPLICATE}) AS duplicate, count(*) FILTER (fault = {CUT}) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT done.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM done LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM done.conv_id LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM done.conv_id
"""
