import numpy as np

from kelpforge.llm import chunking


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnoé"), rng.integers(2, 9))) for _ in range(n))


def plain_hashes(data):
    out = []
    for i in range(len(data)):
        h = 0
        for byte in data[max(0, i - chunking.WINDOW + 1) : i + 1]:
            h = ((h << 1) + int(chunking.GEARS[byte])) & 0xFFFFFFFF
        out.append(h)
    return out


def plain_ends(data):
    h, ends, last = plain_hashes(data), [], 0
    for i in range(len(data)):
        end = i + 1
        if h[i] == max(h[max(0, i - chunking.REACH) : i + chunking.REACH + 1]) and end - last > chunking.REACH:
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            if end < len(data):
                ends.append(end)
                last = end
    return [*ends, len(data)] if data else []


def test_cuts_match_the_rolled_hash():
    rng = np.random.default_rng(1)
    for data in (b"", b"a", b"x" * 700, "é漢🙂".encode() * 90, b"ab " * 300, rng.bytes(900).hex().encode(), words(rng, 200).encode()):
        assert chunking.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == plain_hashes(data) if data else True
        assert chunking.chunk_ends(data) == plain_ends(data)
    assert len(set(np.diff(chunking.chunk_ends(b"ab " * 300)).tolist()[1:-1])) == 1


def shared_words(texts, n=chunking.MIN_WORDS):
    """doc -> places of words in a run of ``n`` words that a document with a smaller id has; that any other has."""
    found = {}
    for doc, text in texts.items():
        w = (text or "").split()
        for i in range(len(w) - n + 1):
            found.setdefault(tuple(w[i : i + n]), set()).add(doc)
    later, other = {}, {}
    for doc, text in texts.items():
        w = (text or "").split()
        for i in range(len(w) - n + 1):
            docs = found[tuple(w[i : i + n])]
            if min(docs) < doc:
                later.setdefault(doc, set()).update(range(i, i + n))
            if len(docs) > 1:
                other.setdefault(doc, set()).update(range(i, i + n))
    return later, other


def test_passages_match_brute_force(spark):
    rng = np.random.default_rng(2)
    passages = [words(rng, 51 + 5 * k) for k in range(10)]
    short = [words(rng, 40) for _ in range(4)]
    texts = {0: "", 1: None, 2: "x" * 9000, 3: "x" * 9000}
    for doc in range(4, 80):
        text = [words(rng, rng.integers(1, 40))]
        for p in rng.choice(len(passages), 2, replace=False):
            text += [passages[p], words(rng, rng.integers(1, 30))]
        texts[doc] = " ".join([*text, short[doc % 4], words(rng, 5)])
    texts |= {80: texts[10], 81: f"{texts[20]} {words(rng, 9)}", 82: words(rng, 60)}
    texts[82] = f"{texts[82]} {words(rng, 9)} {texts[82]} {words(rng, 9)}"
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, n_chunks int").repartition(3)
    got = {r.doc_id: r for r in chunking.dedup(docs).collect()}
    later, other = shared_words(texts)
    for doc, text in texts.items():
        text, r = text or "", got[doc]
        at, left = 0, []
        for a, b in r.removed_spans:
            left.append(text[at:a])
            at = b
        assert r.kept_text == "".join([*left, text[at:]])
        w = text.split()
        gone = sum(len(text[a:b].split()) for a, b in r.removed_spans)
        assert r.shared_words == len(other.get(doc, ())), doc
        if doc != 82:
            assert gone == len(later.get(doc, ())), doc
            assert r.kept_text.split() == [x for i, x in enumerate(w) if i not in later.get(doc, ())], doc
        assert (r.n_copied > 0) == (gone > 0)
    assert got[80].kept_text == "" and got[82].shared_words == 0 and len(got[82].kept_text.split()) == 78


def test_clean_documents_stay(spark):
    rng = np.random.default_rng(3)
    texts = [words(rng, 300) + " with a phrase that others have " + words(rng, 5) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.kept_text for r in chunking.dedup(docs).collect()} == dict(enumerate(texts))


def test_missing_and_shared_ids(spark):
    text = words(np.random.default_rng(4), 80)
    rows = [(None, text), (1, text), (1, text), (1, "short"), (2, text), (2, "b")]
    got = chunking.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.kept_text) for r in got) == sorted([("None", text), ("1", text), ("1", text), ("1", "short"), ("2", ""), ("2", "b")])
    assert chunking.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
