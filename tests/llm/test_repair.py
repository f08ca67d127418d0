import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpforge.llm import repair

BLANKS = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        trimmed = text.strip(BLANKS)
        out.append("blank" if not trimmed else "duplicate" if (role, text) in seen else "truncated" if trimmed[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """Cost, audit and repaired rows, from whole audit strings kept for each initial written last."""
    found, ways = faults(rows), {"": (0, "", ())}

    def better(held, last, way):
        if last not in held or way[:2] < held[last][:2]:
            held[last] = way

    def inserted(ways):
        for _ in range(2):
            held = dict(ways)
            for last, (cost, audit, done) in ways.items():
                name = "assistant" if last == "u" else "user"
                better(held, name[0], (cost + 5, audit + "I", (*done, (name, ""))))
            yield ways
            ways = held
        yield ways

    for (role, text), fault in zip(rows, found, strict=True):
        held = {}
        # every number of insertions on its own: a dearer beginning may still be the only one in its state
        for layer in inserted(ways):
            for last, (cost, audit, done) in layer.items():
                due = "assistant" if last == "u" else "user"
                better(held, last, (cost + 2, audit + "D", done))
                if fault in ("", "truncated"):
                    extra = 5 * (fault != "")
                    if role[:1] == due[0] or (role[:1] == "s" and last == ""):
                        better(held, role[:1], (cost + extra, audit + "K", (*done, (role, text))))
                    better(held, due[0], (cost + extra + 1, audit + "R", (*done, (due, text))))
        ways = held
    return min(way for layer in inserted(ways) for last, way in layer.items() if last in ("", "a"))


ROLES = ["user", "assistant", "system", "", " ", "tool", "uncle"]
ROWS = st.lists(st.tuples(st.sampled_from(ROLES), st.sampled_from(["a.", "b!", "no", "", " \t", "c? \n", "é"])), max_size=7)


def exhaustive(rows):
    """As ``brute``, by going through all edits with up to two insertions a place."""
    found, out = faults(rows), None

    def go(i, last, cost, audit, done, run):
        nonlocal out
        if i == len(rows) and last in ("", "a") and (out is None or (cost, audit) < out[:2]):
            out = (cost, audit, tuple(done))
        due = ["a"] if last == "u" else ["u"] + ["s"] * (last == "")
        if run < 2:
            name = "assistant" if last == "u" else "user"
            go(i, name[0], cost + 5, audit + "I", [*done, (name, "")], run + 1)
        if i < len(rows):
            role, text = rows[i]
            go(i + 1, last, cost + 2, audit + "D", done, 0)
            if found[i] in ("", "truncated"):
                extra = 5 * (found[i] != "")
                if role[:1] in due:
                    go(i + 1, role[:1], cost + extra, audit + "K", [*done, (role, text)], 0)
                name = "assistant" if last == "u" else "user"
                go(i + 1, name[0], cost + extra + 1, audit + "R", [*done, (name, text)], 0)

    go(0, "", 0, "", [], 0)
    return out


def run(rows):
    work = repair.Repair()
    codes = {"": repair.SOUND, "blank": repair.BLANK, "duplicate": repair.DUPLICATE, "truncated": repair.CUT}
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        work.add(role[:1], codes[fault], role.encode(), text.encode())
    return work.result()


@settings(max_examples=250, deadline=None)
@given(ROWS.map(lambda x: x[:4]))
def test_edits_are_the_least_of_all(rows):
    cost, audit, done = exhaustive(rows)
    assert brute(rows) == (cost, audit, done)
    assert run(rows) == (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest())
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in done))


@settings(max_examples=400, deadline=None)
@given(ROWS)
def test_longer_conversations(rows):
    cost, audit, digest = run(rows)
    want = brute(rows)
    assert (cost, audit) == want[:2] and digest == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in want[2]).encode()).hexdigest()


def test_codes_are_prefix_free_and_ordered():
    assert repair.CODES == sorted(repair.CODES) == ["D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R"]
    assert not any(a != b and b.startswith(a) for a in repair.CODES for b in repair.CODES)


TALKS = {
    1: [(0, "system", "Be brief."), (1, "user", "Hi?"), (2, "assistant", "Yes."), (4, "user", "More?"), (5, "user", "More?"), (6, "assistant", "cut off")],
    2: [(0, "assistant", "a."), (0, "assistant", "a."), (3, "tool", "x!")],
    3: [(None, "user", "first."), (2, None, None), (9, "assistant", "last!")],
    None: [(1, "", "no role."), (2, "system", "late."), (2, "user", "tie b?"), (2, "user", "tie a?")],
}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(c, t, r, x, "mine") for c, talk in TALKS.items() for t, r, x in talk]
    return spark.createDataFrame(data[::-1], "conv_id long, turn long, role string, text string, fault string").repartition(4)


def plain(talk):
    return sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in talk), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))


def test_conversations(spark, rows):
    got = {r.conv_id: r for r in repair.repairs(rows).collect()}
    done = {}
    for r in repair.repaired(rows).collect():
        done.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    assert set(got) == set(TALKS)
    for conv, talk in TALKS.items():
        own = plain(talk)
        pairs = [(r, x) for _, r, x in own]
        cost, audit, kept = brute(pairs)
        turns = [t for t, _, _ in own if t is not None]
        want = [max(turns) - min(turns) + 1 - len(set(turns)), *[faults(pairs).count(x) for x in ("blank", "duplicate", "truncated")]]
        want += [sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(pairs, pairs[1:], strict=False)), cost, audit]
        assert list(got[conv])[2:9] == want
        assert [(r, x) for _, r, x in sorted(done.get(conv, []))] == list(kept)


def test_damage_and_dropped_conversations(spark, tmp_path):
    data = [(c, t, r, f"Text {c} {t}. Ok?") for c in range(40) for t, r in enumerate(["user", "assistant", None, "user"])] + [(None, None, "user", "x")]
    alone = next(c for c in range(100, 400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    data.append((alone, 0, "user", "dropped."))
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in repair.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert len(got) == 42 and got[alone].audit == "" and got[alone].repaired_sha256 == hashlib.sha256().hexdigest() and got[alone].cost == 0
    for conv in range(40):
        left = []
        for c, t, r, x in data:
            if c == conv:
                kind, r = zlib.crc32(f"{c}:{t}".encode()) % 20, r or " "
                left += [] if kind == 0 else [(t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)] * (1 + (kind == 3))
        cost, audit, kept = brute([(r, x) for _, r, x in plain(left)])
        assert (got[conv].cost, got[conv].audit, got[conv].repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest())


def test_long_conversation_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    long = [(1, t, ("user", "assistant")[t % 2], f"row {t}.") for t in range(30_000)]
    got = repair.repairs(spark.createDataFrame(long, schema)).collect()
    assert [(r.n_rows, r.cost, r.audit) for r in got] == [(30_000, 0, "K" * 30_000)]
    none = spark.createDataFrame([], schema)
    assert repair.repairs(none).count() == 0 and repair.repaired(none).count() == 0
