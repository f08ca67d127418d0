import numpy as np

import __spark_entry__
import corpus_pipeline
from kelpforge.llm import packing
from kelpforge.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark, tmp_path):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), rng.integers(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(80)
    texts = {i: prose(150) for i in range(20)}
    texts |= {20: texts[3], 21: texts[4].replace(" ", "  ", 1), 22: "too short", 23: "same words " * 60, 24: None}
    texts |= {30 + k: f"{prose(100)} {passage} {prose(100)}" for k in range(4)}
    texts[40] = prose(120) + " password=hunter2hunter2"
    (tmp_path / "t").mkdir()
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "t/documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "t/documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path / "t"))
        assert out.columns == COLUMNS
        docs = materialize(out, name)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in kept[name].values())
    assert set(texts) - set(kept["quality_rules"]) == {22, 23, 24}
    assert set(kept["quality_rules"]) - set(kept["near_duplicates"]) == {20, 21}
    after = kept["repeated_passages"]
    assert set(after) == set(kept["near_duplicates"])
    assert all(after[k].text == texts[k] for k in [*range(20), 30, 40])
    middle = " ".join(passage.split()[15:-15])
    assert [middle in after[30 + k].text for k in range(4)] == [True, False, False, False]
    assert kept["secret_scan"][40].text == texts[40].replace("password=hunter2hunter2", "[SECRET]")
    packed = corpus_pipeline.run(spark, str(tmp_path / "t")).toPandas()
    assert set(packed.doc_id) == set(after)
    want = packing.digest(packing.pack(docs)).toPandas()
    ids = ["doc_id", "start"]
    assert packed.groupby("doc_id").length.sum().to_dict() == want.groupby("doc_id").length.sum().to_dict()
    assert packed.duplicated(ids).sum() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
