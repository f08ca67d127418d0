import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from kelpforge.llm import packing, tokens

ODD = [
    "", " ", "  two  blanks ", "tab\tand \n line", "a\x1cb \x1c c", "no break   em", "it's we'll  don't", "ééé ß ñ 漢字 かな 🙂🙂", "x" * 3000,
    "<|endoftext|> stays text", "12 3456 7,8", " lead", "trail ", "\n\n\n", "é combining", "​ zero", "\x00 nul \x85 next", "[#*$] %%% &&&",
]


def ids_of(texts):
    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return [[*x.ids] for x in t.encode_batch(texts, add_special_tokens=False)]


def test_cached_words_give_the_library_ids():
    encoder = tokens.WordEncoder(tokens.default_path(), limit=50)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(ODD)] == ids_of(ODD)


def test_level_minimises_squares():
    rng = np.random.default_rng(0)
    packer, capacity = packing.SumOfSquares(16), 16
    for _ in range(500):
        size = int(rng.integers(1, 16))
        counts = packer.levels[1:capacity].astype(int)
        best = []
        for level in range(capacity - size + 1):
            if level and not packer.levels[level]:
                continue
            after = counts.copy()
            if level:
                after[level - 1] -= 1
            if level + size < capacity:
                after[level + size - 1] += 1
            best.append(((after**2).sum(), level))
        chosen = packer.level_for(size)
        assert (min(best)[0], chosen) in best
        packer.place(size, None)
        assert packer.levels[1:capacity].sum() == sum(len(x) for x in packer._open)


@pytest.mark.parametrize("partitions", [1, 3])
def test_pieces_hold_each_id_once_with_little_padding(spark, partitions):
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gämma", "delta7", "!!", "\n"]
    texts = [*ODD, *[" ".join(rng.choice(words, rng.integers(1, 1500))) for _ in range(150)]]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(partitions)).toPandas()
    for i, ids in enumerate(ids_of(texts)):
        want, at = np.array([*ids, 0], "<u4"), 0
        for r in got[got.doc_id == i].sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(want)) and r.ids == want[at : at + r.length].tobytes()
            at += r.length
        assert at == len(want)
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 1024
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    padding = [0 if n & (n - 1) == 0 else 1024 - n for n in used.astype(int)]
    assert sum(padding) == 0


def test_digest_and_empty_table(spark):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    row = packing.digest(packing.pack(spark.createDataFrame([(5, None)], schema))).first()
    assert (row.doc_id, row.start, row.length, row.ids_crc32, row.doc_tokens, row.offset) == (5, 0, 1, zlib.crc32(b"\0\0\0\0"), 1, 0)
