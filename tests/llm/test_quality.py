import re

from kelpforge.llm import quality


def brute(rows):
    """The contract's statistics and the verdict, in plain Python."""
    per_host, seen = {}, {}
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    for _, text, host in rows:
        lines = {norm(x) for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)}
        per_host.setdefault(host or "", set()).add(text or "")
        for line in lines:
            seen.setdefault((host or "", line), set()).add(text or "")
    out = []
    for doc, text, host in rows:
        t, host = text or "", host or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(5)}
        frequent = lambda x: len(seen.get((host, norm(x)), ())) > quality.LINE_TEXTS and 100 * len(seen[host, norm(x)]) > quality.LINE_PERCENT * len(per_host[host])
        left = sum(len(x.split()) for x in lines if not frequent(x))
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        kept = not failed and left >= 10 and 100 * left >= quality.MIN_LEFT_PERCENT * len(words)
        out.append((doc, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, kept))
    return out


def test_matches_brute_force(spark):
    common = "Read our terms before you use this site."
    rows = [(i, f"doc {i} " + " ".join(f"w{i}x{k}é" for k in range(12)) + f"\n{common.upper() if i % 2 else '  ' + common}\n", "a") for i in range(30)]
    rows += [(100 + i, f"only {i}\n{common}", "a") for i in range(12)]
    rows += [(200, None, None), (201, "", ""), (202, " \n\t\n", "a"), (203, "a b c d e a b c d e " * 3, "b"), (204, "# * $ % & | < > x y z w", None), (205, "l\nl\nl\n" + " ".join(map(str, range(60))), "b")]
    rows += [(206, " ".join(f"q{k}" for k in range(3000)) + " tail one two three four five tail one two three four five", "b"), rows[3], rows[3]]
    frame = spark.createDataFrame([(*r, "mine", 7) for r in rows], "doc_id long, text string, source string, _words string, kept int").repartition(3)
    got = quality.judge(frame)
    assert "_words" in got.columns and got.columns.count("kept") == 1
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(brute(rows))
    cleaned = {r.doc_id: r.clean_text for r in got.collect()}
    assert common.lower() not in cleaned[5].lower() and "w5x3é" in cleaned[5]
    assert got.where("kept").count() == sum(r[-1] for r in brute(rows))


def test_copies_of_a_text_are_one_document(spark):
    text = " ".join(f"word{k}" for k in range(40))
    frame = spark.createDataFrame([(i, text, "a") for i in range(50)], "doc_id long, text string, source string")
    assert quality.judge(frame).where("kept").count() == 50


def test_empty(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
