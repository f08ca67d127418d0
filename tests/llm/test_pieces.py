import numpy as np
import pytest
import sentencepiece

from kelpforge.llm import pieces


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(pieces.default_path())


def every(lattice, text):
    """All segmentations of a text with its blank mark, as (score, ids), by plain recursion over the whole text."""
    if not text:
        yield 0, ()
        return
    for k in range(1, len(text) + 1):
        found = lattice.pieces.get(text[:k])
        if k == 1 and not found:
            head = tuple(lattice.byte_ids[b] for b in text[0].encode()), lattice.unknown
        elif found:
            head = (found[0],), found[1]
        else:
            continue
        for score, ids in every(lattice, text[k:]):
            yield score + head[1], head[0] + ids


TEXTS = ["a", "hello", " in the", "the inn", "  two", "漢é x", "aaaa", "tion er", "\n y", "a b c d"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("n", [1, 2, 3, 8])
def test_best_n_match_all_segmentations(lattice, text, n):
    encoder = pieces.Encoder(pieces.default_path(), n)
    want = sorted(every(lattice, "▁" + text.replace(" ", "▁")), key=lambda x: -x[0])
    got = [(s, tuple(np.frombuffer(ids, "<u4").tolist())) for s, ids in encoder.encode(text)]
    assert [s for s, _ in got] == [s for s, _ in want[:n]]
    assert len(set(got)) == len(got) and set(got) <= set(want)
    assert {x for x in want if x[0] > got[-1][0]} <= set(got)


def test_part_search_order(lattice):
    for part in ("▁hello", "▁漢x", "tionaller", "▁▁▁a"):
        want = sorted(every(lattice, part), key=lambda x: (-x[0], x[1][::-1]))[:12]
        assert [(s, tuple(np.frombuffer(i, "<u4").tolist())) for s, i in lattice.nbest(part, 12)] == want
        score, gap, ids = lattice.first(part)
        assert (score, tuple(np.frombuffer(ids, "<u4").tolist())) == want[0] and gap == (score - want[1][0] if len(want) > 1 else pieces.NEVER)


def test_long_parts_as_short_ones(lattice, monkeypatch):
    rng = np.random.default_rng(2)
    parts = ["▁hello", "▁漢x", "tionaller", "▁▁▁a", "aaaaaaaaaa", "▁" + "ab" * 9, *["▁" + "".join(rng.choice(list("etaoin漢"), 14)) for _ in range(40)]]
    want = {(p, n): lattice.nbest(p, n) for p in parts for n in (1, 2, 3, 9)} | {p: lattice.first(p) for p in parts}
    monkeypatch.setattr(pieces, "LONG", 0)
    assert {(p, n): lattice.nbest(p, n) for p in parts for n in (1, 2, 3, 9)} | {p: lattice.first(p) for p in parts} == want


def test_unbroken_text_of_a_million_characters():
    import resource

    encoder = pieces.Encoder(pieces.default_path(), 3)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for text in ("".join(np.random.default_rng(3).choice(list("abcdefghijklmnop0123456789+/漢"), 1_000_000)), "a" * 100_000):
        found = encoder.encode(text)
        assert len(found) == 3 and all(encoder.lattice.decode(np.frombuffer(ids, "<u4")) == text for _, ids in found)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


def test_decoding_is_the_library_s(lattice):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    encoder = pieces.Encoder(pieces.default_path(), 3)
    for text in [*TEXTS, "", " ", "   lead and trail  ", "é漢🙂\x00\t\r\n" * 20, "x" * 5000, "Es ist. " * 500]:
        for _, ids in encoder.encode(text):
            ids = np.frombuffer(ids, "<u4")
            assert lattice.decode(ids) == text == model.decode(ids.tolist())


def test_rows(spark):
    rows = [(None, None, 1), (1, "", 1), (2, "ab ab", 1), (2, "ab ab", 1)]
    got = pieces.encode_nbest(spark.createDataFrame(rows, "doc_id long, text string, rank int")).collect()
    assert sorted((str(r.doc_id), r.rank, r.decoded) for r in got if r.doc_id != 2) == [("1", 1, ""), ("None", 1, "")]
    assert sorted((r.rank, r.decoded) for r in got if r.doc_id == 2) == sorted([(k, "ab ab") for k in (1, 2, 3)] * 2)
    assert pieces.encode_nbest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
