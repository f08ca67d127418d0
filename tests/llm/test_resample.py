import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpforge.llm import bytewords, resample

UNBLANK, ALPHANUMERIC = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aZ09 \t\n.-éÉß日🙂\x7f\x00"), max_size=30), st.just("x" * 150), st.just("É" * 80 + " y")), max_size=8)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(0, 3))
def test_words_and_checksums(texts, skipped):
    column, left = pa.array(texts, pa.string()).slice(skipped), texts[skipped:]
    for inside, pattern in ((bytewords.UNBLANK, UNBLANK), (bytewords.ALPHANUMERIC, ALPHANUMERIC)):
        words = bytewords.scan(column, inside)
        want = [(k, w.encode()) for k, t in enumerate(left) for w in re.findall(pattern, lowered(t))]
        assert [(int(k), words.data[a:b].tobytes()) for k, a, b in zip(words.row, words.starts, words.ends, strict=True)] == want
        assert bytewords.crc32(words.data, words.starts, words.ends).tolist() == [zlib.crc32(w) for _, w in want]
        values = bytewords.hashes(words)
        assert len(set(zip([w for _, w in want], values.tolist(), strict=True))) == len({w for _, w in want}) == len(set(values.tolist()))
        for n in (1, 2, 5):
            row, found = bytewords.runs(words, values, n, short=True)
            tokens = [[w for j, w in want if j == k] for k in range(len(left))]
            runs = [(k, tuple(t[i : i + n])) for k, t in enumerate(tokens) for i in range(max(1, len(t) - n + 1)) if t]
            assert sorted(row.tolist()) == sorted(k for k, _ in runs)
            assert len(set(found.tolist())) == len({r for _, r in runs})
            assert Counter(Counter(zip(row.tolist(), found.tolist(), strict=True)).values()) == Counter(Counter(runs).values())


def brute(rows, target, buckets, longest, seed, least, percent):
    def found(text):
        words = re.findall(ALPHANUMERIC, lowered(text))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(k for _, x in rows for k in found(x)[1]), Counter(k for x in target for k in found(x)[1])
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.total() + buckets) / ((s[k] + 1) * (t.total() + buckets)))) for k in range(buckets)]
    out = []
    for doc, text in rows:
        words, features = found(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] for k in features)
        out.append([doc, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    for k, x in enumerate(able[: len(able) * percent // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}É" for i in range(300)] + ["The", "the-end", "日本"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(15, 60)))) for i in range(120)]
    rows += [(None, None), (500, ""), (501, " -- \n"), (502, "z" * 400 + " " + "long " * 5000), rows[3], rows[3], (None, rows[4][1]), (7, rows[5][1])]
    target = [" ".join(rng.choice(vocabulary[:40], 30)) for _ in range(10)] + [None]
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, score double").repartition(5)
    for longest, percent in ((1, 10), (3, 60)):
        wanted = spark.createDataFrame([(x,) for x in target], "text string")
        got = resample.importance_resample(docs, wanted, buckets=97, longest=longest, percent=percent, seed=5)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, target, 97, longest, 5, 20, percent)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.importance_resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    got = resample.importance_resample(one, none, min_words=1, percent=100).collect()
    assert [(r.doc_id, r.n_features, r.rank) for r in got] == [(1, 3, 1)]


def test_ranks_over_many_partitions(spark):
    rows = spark.range(2000).selectExpr("pmod(id * 37, 101) AS v", "id")
    from pyspark.sql import functions as F

    got = {r.id: r["rank"] for r in resample.ranked(rows.repartition(7), F.desc("v"), F.asc("id")).collect()}
    want = sorted(range(2000), key=lambda k: (-(k * 37 % 101), k))
    assert [got[k] for k in want] == list(range(1, 2001))
