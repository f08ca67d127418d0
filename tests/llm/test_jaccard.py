import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpforge.llm import jaccard


def shingles(text, words=5):
    found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def brute(rows, words=5):
    """doc_id, set size and least id reachable of each row, over all pairs."""
    sets, label = [shingles(t, words) for _, t in rows], list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
                links += sets[i] != sets[j]
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str), links


def corpus(seed, copies):
    """Groups of edited copies, texts that share a passage, short texts."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}é" for i in range(500)]
    texts = ["", None, " \n", "One", "one", "one two", "TWO words", "a b c d", "a b c d e", "a b c d e f"]
    passage = list(rng.choice(vocabulary, 60))
    for k in range(6):
        base = list(rng.choice(vocabulary, int(rng.integers(30, 200))))
        for c in range(copies if k == 0 else 6):
            edited = base.copy()
            for at in rng.choice(len(base), int(rng.integers(0, 5)), replace=False):
                edited[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(edited[: len(edited) - c % 4]))
    for k in range(40):
        texts.append(" ".join([*rng.choice(vocabulary, k % 20), *passage]))
    return [(int(i), t) for i, t in enumerate(rng.permutation(np.array(texts, object)).tolist())]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed, 120)
    rows += [(None, rows[11][1]), (None, "no such text in here at all"), rows[12], (rows[13][0], rows[40][1]), (9999, rows[20][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, class string, token int").repartition(5)
    got = sorted((tuple(r) for r in jaccard.shingle_components(docs).collect()), key=str)
    want, links = brute(rows)
    assert got == want and links > 500


def test_what_the_earliest_classes_miss_is_paired(spark):
    """A chain in which each text is like its neighbours alone."""
    words = [f"w{i}" for i in range(400)]
    chain = [(k, " ".join(words[8 * k : 8 * k + 104])) for k in range(36)]
    docs = spark.createDataFrame(chain, "doc_id long, text string")
    want, links = brute(chain)
    assert links == 35 and {c for _, _, c in want} == {0}
    assert sorted((tuple(r) for r in jaccard.shingle_components(docs).collect()), key=str) == want


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_prefixes_lose_no_pair(seed):
    """Of any two sets that are alike, as many tokens as the lesser choice lie in both prefixes, whatever the choices."""
    rng = np.random.default_rng(seed)
    base = rng.permutation(300)[: int(rng.integers(1, 120))]
    drop = [np.delete(base, rng.choice(len(base), int(rng.integers(0, max(1, len(base) // 8))), replace=False)) for _ in range(2)]
    x, y = (np.sort(np.concatenate([d, 300 + 100 * k + np.arange(int(rng.integers(0, 6)))])) for k, d in enumerate(drop))
    if not len(x) or not len(y):
        return
    both, n = len(set(x) & set(y)), np.array([len(x), len(y)])
    if 9 * both < 4 * n.sum():
        return
    asked = [int(rng.integers(1, min(jaccard.MOST, int(jaccard.least_shared(n)[k])) + 1)) for k in range(2)]
    total, m = -(-4 * int(n.sum()) // 9), min(asked)
    rank = rng.permutation(1000)
    x, y = (s[np.argsort(rank[s])] for s in (x, y))
    for k, s in enumerate((x, y)):
        assert len(s) - total + m <= len(s) - int(jaccard.least_shared(n)[k]) + asked[k]
    assert len(set(x[: len(x) - total + m]) & set(y[: len(y) - total + m])) >= m


def test_choices_follow_cost():
    n = np.array([100, 100])
    rare, common = np.zeros(100, np.int64), np.full(100, 1000)
    common[:13] = 0  # what an equal partner could share begins beyond the first prefix
    assert jaccard.choices(n, np.concatenate([rare, common]), np.repeat([0, 1], 100), np.array([0, 100])).tolist() == [1, 1]
    assert jaccard.choices(n, np.concatenate([np.full(100, 1000)] * 2), np.repeat([0, 1], 100), np.array([0, 100])).tolist() == [8, 8]


def test_long_text_and_empty_table(spark):
    long = " ".join(str(k) for k in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "z" * 300_000)], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.shingle_components(docs).collect()) == [(1, 59_996, 1), (2, 59_997, 1), (3, 1, 3)]
    assert jaccard.shingle_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
