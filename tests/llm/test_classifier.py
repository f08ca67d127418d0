import zlib

import numpy as np

from kelpforge.llm import classifier


def corpus(n=600):
    rng = np.random.default_rng(1)
    fresh = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows = []
    for i in range(n):
        words = [fresh() for _ in range(60)]
        label = int(i % 4 != 0)
        if not label:
            words = [f"{w.upper()}!!" for w in words] if i % 8 else [w for w in words[:6] for _ in range(10)]
        rows.append((i, " ".join(words), label))
    return rows


def test_held_out_accuracy_and_leaks(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    flipped = [(i, (1 - y) if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows]
    schema = "doc_id long, quality int"
    weights = classifier.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], schema), bits=14)
    assert (weights == classifier.train(docs, spark.createDataFrame(flipped, schema).repartition(3), bits=14)).all()
    got = {r.doc_id: r.score for r in classifier.score(docs, weights, bits=14).collect()}
    held = [(got[i] >= 0.5, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([p == y for p, y in held]) > 0.97


def test_updates_follow_the_definition():
    rng = np.random.default_rng(2)
    model, z, n = classifier.Ftrl(8), [0.0] * 9, [0.0] * 9

    def weight(i):
        if abs(z[i]) <= classifier.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * classifier.L1) / ((classifier.BETA + n[i] ** 0.5) / classifier.ALPHA + classifier.L2)

    for _ in range(200):
        at = np.sort(rng.choice(8, 3, replace=False))
        x, y = rng.random(3), int(rng.random() < 0.4)
        model.learn(at, x, y)
        places, values = [*at.tolist(), 8], [*x.tolist(), 1.0]
        w = [weight(i) for i in places]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, values, strict=True))))
        for i, v, wi in zip(places, values, w, strict=True):
            g = (p - y) * v
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / classifier.ALPHA * wi
            n[i] += g * g
    assert np.allclose(model.weights(), [weight(i) for i in range(9)])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (2, "  ")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    weights = classifier.train(docs, none, bits=10)
    assert not weights.any()
    assert [r.score for r in classifier.score(docs, weights, bits=10).collect()] == [0.5] * 4
    assert classifier.score(docs.limit(0), weights, bits=10).count() == 0


def test_repeated_ids_and_clashing_names(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([(i, t, 9, 9.0) for i, t, _ in rows], "doc_id long, text string, label int, score double")
    labels = spark.createDataFrame([(i, y, "x", 1) for i, _, y in rows], "doc_id long, quality int, text string, toxic int")
    weights = classifier.train(docs, labels, bits=12)
    assert weights.any() and (weights == classifier.train(docs.union(docs).union(docs.limit(5)), labels.union(labels), bits=12)).all()
    got = classifier.score(docs, weights, bits=12)
    assert got.columns == ["doc_id", "score"] and got.count() == 60


def test_scores_match_plain_sums(spark):
    rows = corpus(40)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    weights = np.random.default_rng(3).normal(size=(1 << 12) + 1)
    got = {r.doc_id: r.score for r in classifier.score(docs, weights, bits=12).collect()}
    for i, text, _ in rows:
        at, x = classifier.Features(12)(text)
        assert len(set(at.tolist())) == len(at)
        margin = weights[-1] + sum(weights[a] * b for a, b in zip(at.tolist(), x.tolist(), strict=True))
        assert abs(got[i] - 1 / (1 + np.exp(-margin))) < 1e-9
