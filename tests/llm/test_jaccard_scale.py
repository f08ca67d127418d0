from kelpforge.llm import jaccard


def test_a_prefix_is_one_row(spark):
    """Candidates are counted on one row a class; before, each class met all its tokens."""
    texts = [(k, " ".join(f"w{(7 * k + j) % 500}" for j in range(100))) for k in range(20)] + [(20, "one two"), (21, ""), (22, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    marked, frequent, sets = jaccard._marked(docs, 5)
    rows = jaccard.prefixes(docs, frequent, sets, 5).collect()
    assert len(rows) == 21 and sorted(r.n for r in rows) == [1] + [96] * 20
    for r in rows:
        assert len(r.tokens) == len(set(r.tokens)) == r.n - int(jaccard.least_shared(jaccard.np.array([r.n]))[0]) + r.asked
