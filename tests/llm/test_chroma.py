import numpy as np

from kelpforge.llm import chroma


def tune(rng, notes):
    return chroma.rendered(rng.normal(size=notes))


def plain_response(image, t, spec):
    kind, p, h, w = spec
    box = image[t : t + w, p : p + h]
    part = [box[:, : h // 2], box[: w // 2], None, box[:, h // 3 : 2 * (h // 3)], box[w // 3 : 2 * (w // 3)]][kind]
    part = box[: w // 2, : h // 2].sum() + box[w // 2 :, h // 2 : h].sum() if kind == 2 else part.sum()
    return np.log((1 + part) / (1 + box.sum() - part))


def test_integral_image_filters():
    image = np.random.default_rng(1).random((40, chroma.PITCHES))
    got = chroma.responses(image)
    assert got.shape == (40 - chroma.WIDEST + 1, len(chroma.FILTERS))
    for t in range(len(got)):
        assert np.allclose(got[t], [plain_response(image, t, f) for f in chroma.FILTERS])


def brute(prints, queries):
    out = set()
    for q in queries:
        for r, ints in prints.items():
            if r == q:
                continue
            for offset in range(-len(prints[q]), len(ints)):
                a, b = ints[max(offset, 0) :], prints[q][max(-offset, 0) :]
                n = min(len(a), len(b))
                if n >= chroma.MIN_OVERLAP and np.bitwise_count(a[:n] ^ b[:n]).sum() <= chroma.MAX_ERROR * 32 * n:
                    out.add((q, r))
    return out


def test_shifted_and_noisy_copies_align(spark):
    rng = np.random.default_rng(2)
    base = [tune(rng, 90) for _ in range(30)]
    audio = dict(enumerate(base))
    for k in range(12):
        cut = base[k][chroma.HOP * 7 * (k % 4) :]
        audio[100 + k] = cut + rng.normal(0, 0.02 * cut.std(), len(cut))
    audio[200] = base[3].copy()
    rows = [(k, (np.clip(x / np.abs(x).max(), -1, 1) * 32767).astype("<i2").tobytes(), "x") for k, x in audio.items()]
    rows += [(300, None, "x"), (301, b"\0\0\0", "x"), (None, rows[0][1], "x"), rows[5]]
    media = spark.createDataFrame(rows, "media_id long, sound binary, ints string")
    marked = chroma.fingerprints(media, id_col="media_id", audio_col="sound")
    got = chroma.align(marked.where("rec_id % 4 = 0"), marked).collect()
    prints = {r.rec_id: np.array(r.ints, np.int32).view(np.uint32) for r in marked.collect() if r.rec_id is not None and r.ints}
    want = brute(prints, [k for k in prints if k % 4 == 0])
    pairs = {(r.query_id, r.rec_id): r for r in got}
    assert len(pairs) == len(got) and set(pairs) <= want and len(pairs) >= 0.9 * len(want)
    for q, r in ((0, 100), (4, 104), (8, 108)):
        assert (q, r) in pairs and pairs[q, r].offset == -7 * (q % 4)
    row = pairs[104, 4]
    a, b = prints[4][max(row.offset, 0) :], prints[104][max(-row.offset, 0) :]
    n = min(len(a), len(b))
    assert (row.overlap, row.bit_errors) == (n, int(np.bitwise_count(a[:n] ^ b[:n]).sum()))


def test_wrong_bits_in_every_frame_align(spark):
    rng = np.random.default_rng(3)
    prints = {k: rng.integers(0, 2**32, n, dtype=np.uint32) for k, n in enumerate((40, 84, 300, 24, 23, 700))}
    for k in range(6):  # three wrong bits a frame, so that no two frames are equal
        flips = np.array([sum(1 << int(b) for b in rng.choice(32, 3, replace=False)) for _ in prints[k]], np.uint32)
        prints[10 + k] = np.concatenate([rng.integers(0, 2**32, 5 * k, dtype=np.uint32), prints[k] ^ flips])[: 60 * (k + 1)]
    frame = spark.createDataFrame([(k, x.view(np.int32).tolist()) for k, x in prints.items()], "rec_id long, ints array<int>")
    got = {(r.query_id, r.rec_id): r for r in chroma.align(frame, frame).collect()}
    assert set(got) == brute(prints, list(prints)) and len(got) == 6
    assert (got[2, 12].offset, got[12, 2].offset, got[2, 12].overlap) == (10, -10, 170)


def test_unlike_frames_and_wrong_bits_at_the_limit():
    """Recall on frames that are not like their neighbours, with bit errors up to the limit, against all offsets."""
    rng = np.random.default_rng(11)
    found = wanted = 0
    for rate in (0, 1 / 32, 3 / 32, chroma.MAX_ERROR):
        known = {k: rng.integers(0, 2**32, int(rng.integers(64, 200)), dtype=np.uint32) for k in range(60)}
        asked = {}
        for k, x in known.items():
            begin = int(rng.integers(0, len(x) - 63))
            cut = np.concatenate([rng.integers(0, 2**32, int(rng.integers(0, 20)), dtype=np.uint32), x[begin:]])
            wrong = rng.random((len(cut), 32)) < rate
            asked[1000 + k] = cut ^ (wrong * (1 << np.arange(32, dtype=np.uint64))).sum(axis=1).astype(np.uint32)
        got = {(1000 + q, r) for q, r, *_ in chroma.offsets(list(asked.values()), list(known.values()))}
        want = brute(known | asked, asked) - {(q, r) for q in asked for r in asked}
        assert got <= want
        found, wanted = found + len(got), wanted + len(want)
    assert found >= 0.98 * wanted and wanted > 140


def test_empty(spark):
    none = spark.createDataFrame([], "media_id long, sound binary")
    marked = chroma.fingerprints(none, id_col="media_id", audio_col="sound")
    assert marked.count() == 0 and chroma.align(marked, marked).count() == 0


def test_query_and_clashing_names(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(50, 64))
    vectors[7] = vectors[20] + rng.normal(0, 0.05, 64)
    vectors[9] = vectors[20]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(vectors)]
    spark.createDataFrame([*rows, rows[9], (60, None, 1), (None, vectors[20].tolist(), 1)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.query_id: r for r in chroma.op2_chroma_alignment(spark, str(tmp_path)).collect()}
    # 0, 20 and 40 are quoted by 5, 25 and 45; 7 and 9 are like 20, so 25 quotes them too; so is the row without an id, which matches nothing
    assert set(got) == {0, 20, 40, 60} and [got[k].n_matches for k in (0, 20, 40, 60)] == [1, 3, 1, 0]
    assert (got[20].class_id, got[20].best_id, got[20].best_errors, got[0].class_id, got[60].n_frames) == (7, 9, 0, 0, 0)
    assert (got[0].best_id, got[40].best_id) == (5, 45) and got[0].best_offset > chroma.MIN_OVERLAP and got[0].best_errors > 0
    extra = spark.createDataFrame([(1, [5] * 80, 3), (2, [5] * 80, 4)], "rec_id long, ints array<int>, class int")
    assert {(r.query_id, r.rec_id, r.overlap) for r in chroma.align(extra, extra).collect()} == {(1, 2, 80), (2, 1, 80)}
