import numpy as np
import pytest
from xxhash import xxh64_intdigest

from kelpforge.llm import simhash


def brute(texts):
    """doc -> (fingerprint, least reachable), without trees."""
    prints = []
    for text in texts:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64_intdigest(x, seed=42) for x in runs]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return prints, label


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}É" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary, 120)) for _ in range(30)]
    texts = ["", None, "One", "one", "one two", *base]
    for text in base[:12]:
        words = text.split()
        words[7] = "edited"
        texts += [" ".join(words), text.upper().replace("É", "É"), text + " tail"]
    prints, label = brute(texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.components(docs).collect()}
    assert got == {i: (f"{p:016x}", l) for i, (p, l) in enumerate(zip(prints, label, strict=True))}


@pytest.mark.parametrize("spread", [2, 12, 64])
def test_links_lose_nothing(spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = set(centres.tolist())
    for c in rng.choice(centres, 3000):
        flips = rng.choice(spread, min(spread, rng.integers(0, 5)), replace=False)
        fps.add(int(np.int64(np.uint64(c) ^ np.uint64(sum(1 << int(b) for b in flips)))) if spread < 64 else int(c ^ np.int64(sum(1 << int(b) for b in flips if b < 63))))
    fps = np.array(sorted(fps), np.int64)
    want = _classes(fps, [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps.view(np.uint64)[i] ^ fps.view(np.uint64)) <= 3)])
    place = {int(x): i for i, x in enumerate(fps)}
    pairs = []
    for half in (0, 1):
        tree = simhash.VantageTree(simhash._half(fps[::3].copy(), half), 12)
        homes = np.zeros(len(fps), int)
        for _, at, home in tree.deal(simhash._half(fps, half)):
            homes[at[home]] += 1
            pairs += [(place[a], place[b]) for a, b in simhash.links(fps[at], home, half)]
        assert (homes == 1).all()
    assert len(pairs) <= 60 * len(fps)
    assert _classes(fps, pairs) == want


def _classes(fps, pairs):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(int(b))
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(len(fps))]


def test_empty_table_and_missing_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.components(spark.createDataFrame([], schema)).count() == 0
    rows = simhash.components(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "z z z")], schema)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("4", "4"), ("None", "4"), ("None", "None")]


def test_near_components_match_brute_force(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(900)]
    base = [list(rng.choice(vocabulary, rng.integers(60, 260))) for _ in range(25)]
    texts = ["", None, " \n", "one", "one", "One two"]
    for words in base:
        texts.append(" ".join(words))
        for edits in (1, 2, 4, 8):
            edited = words.copy()
            for at in rng.choice(len(words), edits, replace=False):
                edited[at] = "edited"
            texts.append(" ".join(edited))
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, texts[6], "x"), rows[6]], "doc_id long, text string, component_id string").repartition(3)

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = _classes(texts, pairs)
    got = {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want and sum(i != w for i, w in enumerate(want)) > 40
    kept = simhash.stage(docs.select("doc_id", "text")).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["None", "6", *[str(i) for i, w in enumerate(want) if i == w]])
