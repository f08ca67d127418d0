"""Deterministic ranked retrieval, budgets, and the evaluation of what was retrieved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.stored import kept_together

#: Records that meet the questions in one task.
MATCHED = 4096


def matches(questions: DataFrame, records: DataFrame) -> DataFrame:
    """``question_id, record_id, lexical``: how many distinct terms a question and a record share.

    Terms meet by an equality join, questions being the small side; no question is held against a record that shares no term.
    Records are dealt by id before they meet questions, MATCHED at a time, so that their pairs are summed in the task that finds
    them: pairs are not shuffled, and no task has more of them than MATCHED records give.
    """
    asked = questions.select("question_id", F.explode(X.terms(F.col("question"))).alias("term"))
    held = kept_together(records, "record_id", MATCHED).select("record_id", F.explode(X.terms(F.col("text"))).alias("term"))
    return held.join(asked, "term").groupBy("question_id", "record_id").agg(F.count("*").alias("lexical"))


def top(scored: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` rows of each question; Spark cuts to ``k`` in each task before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).where(F.col("rank") <= k)


def relevant(records: DataFrame, question: str) -> DataFrame:
    """Records relevant to one question, with what they are ranked by.

    A record that names an entity other than the question's is left out; else a shared entity, a matched intent or any
    shared term makes it relevant. Columns: id, kind, text, entity, confidence, published_at.
    """
    asked = X.terms(F.lit(question))
    wanted = X.entity_terms(asked)
    own = X.terms(F.col("text"))
    named = X.terms(F.coalesce("entity", F.lit("")))
    special = X.entity_terms(named)
    mismatch = (F.size(special) > 0) & (F.size(wanted) > 0) & ~F.arrays_overlap(special, wanted)
    intent = X.intent_matched(F.col("kind"), asked)
    lexical = F.size(F.array_intersect(asked, own))
    return records.where((F.size(asked) > 0) & ~mismatch & (intent | (lexical > 0))).withColumns({"entity_matches": F.size(F.array_intersect(wanted, named)), "intent": intent.cast("int"), "lexical": lexical})


def ranking() -> list[Column]:
    return [F.desc("entity_matches"), F.desc("intent"), F.desc("lexical"), F.desc(F.coalesce("confidence", F.lit(0.0))), F.desc(F.coalesce(F.unix_timestamp("published_at"), F.lit(0))), F.asc("id")]


def fit_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """Rows taken greedily in rank order within a token budget: one that does not fit is passed over, later ones may fit.

    ``question_id, rank, record_id, tokens`` in, of a bounded number of rows a question; ``used`` is the running sum.
    """
    items = F.array_sort(F.collect_list(F.struct("rank", "record_id", "tokens")))
    begin = F.expr("struct(0L AS used, array() :: array<struct<rank: int, record_id: bigint, tokens: bigint, used: bigint>> AS taken)")

    def step(acc, x):
        total = acc["used"] + x["tokens"]
        taken = F.concat(acc["taken"], F.array(F.struct(x["rank"].alias("rank"), x["record_id"].alias("record_id"), x["tokens"].alias("tokens"), total.alias("used"))))
        return F.when(total <= budget, F.struct(total.alias("used"), taken.alias("taken"))).otherwise(acc)

    folded = ranked.groupBy("question_id").agg(F.aggregate(items, begin, step, lambda acc: acc["taken"]).alias("taken"))
    return folded.select("question_id", F.inline("taken"))


def answer_state(outcomes: DataFrame) -> DataFrame:
    """The state of each answer from counts ``conflicts, fitting, candidates, pending``: conflict first, then what was found."""
    state = F.when((F.col("candidates") > 0) & (F.col("conflicts") > 0), "conflicting_sources").when(F.col("fitting") > 0, "valid_answer").when(F.col("candidates") > 0, "partial_answer")
    return outcomes.withColumn("answer_state", state.when(F.col("pending") > 0, "needs_human_validation").otherwise("not_found"))


def with_evidence(records: DataFrame, spans: DataFrame, sources: DataFrame) -> DataFrame:
    """Records with the quote of their evidence and the title of their source, where there are any."""
    quote = X.public_quote(F.col("quote"))
    held = spans.select("evidence_id", F.when(F.length(quote) > 500, F.concat(F.substring(quote, 1, 497), F.lit("..."))).otherwise(quote).alias("quote"))
    return records.join(held, "evidence_id", "left").join(sources.select("source_id", "title"), "source_id", "left")


def quoted(docs: DataFrame, quotes: DataFrame, piece: int = 5) -> DataFrame:
    """``doc_id, question_id`` for each text of ``docs`` that contains a ``quote``.

    A quote of some words contains runs of whole words that the text has, too; the run of ``piece`` words after its first word, which
    may be a part of one, is its key, and equal keys are joined before texts are searched. Quotes too short for that are
    searched in every text, as there is nothing to join by.
    """
    words = lambda x: F.filter(F.split(F.col(x), r"\s+"), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - piece), lambda k: F.xxhash64(F.array_join(F.slice("w", k + 1, piece), " ")))
    asked = quotes.select("question_id", "quote", words("quote").alias("w"))
    keyed = asked.where(F.size("w") >= piece + 2).select("question_id", "quote", F.xxhash64(F.array_join(F.slice("w", 2, piece), " ")).alias("key"))
    wanted = docs.select("doc_id", words("text").alias("w")).where(F.size("w") >= piece).select("doc_id", F.explode(F.array_distinct(runs)).alias("key"))
    met = wanted.join(keyed, "key").select("doc_id", "question_id", "quote")
    found = met.join(docs.select("doc_id", "text"), "doc_id").where(F.contains(F.col("text"), F.col("quote"))).select("doc_id", "question_id")
    short = asked.where(F.size("w") < piece + 2).select("question_id", "quote")
    return found.union(docs.join(short, F.contains(F.col("text"), F.col("quote"))).select("doc_id", "question_id")).distinct()


def recall_at(expected: Column, actual: Column, k: int) -> Column:
    """Share of the expected ids among the first ``k``; with nothing expected, one if nothing came."""
    hits = F.size(F.filter(expected, lambda x: F.array_contains(F.slice(actual, 1, k), x)))
    return F.when(F.size(expected) == 0, F.when(F.size(actual) == 0, 1.0).otherwise(0.0)).otherwise(hits / F.size(expected))


def reciprocal_rank(expected: Column, actual: Column) -> Column:
    """One over the rank of the first expected id; with nothing found, one if nothing was expected, else zero."""
    ranks = F.filter(F.transform(actual, lambda x, k: F.when(F.array_contains(expected, x), k + 1)), lambda k: k.isNotNull())
    return F.when(F.size(ranks) > 0, 1.0 / F.array_min(ranks)).when(F.size(expected) == 0, 1.0).otherwise(0.0)


def quoted_share(expected: Column, quotes: Column) -> Column:
    """Share of the expected quotes that some citation holds."""
    hits = F.size(F.filter(expected, lambda q: F.exists(quotes, lambda c: F.contains(c, q))))
    return F.when(F.size(expected) == 0, F.when(F.size(quotes) == 0, 1.0).otherwise(0.0)).otherwise(hits / F.size(expected))


def set_scores(expected: DataFrame, predicted: DataFrame, by: list[str], key: str = "item") -> DataFrame:
    """Precision, recall and F1 of predicted against expected sets, for each group; repeated items count once."""
    sides = expected.select(*by, key, F.lit(1).alias("e"), F.lit(0).alias("p")).unionByName(predicted.select(*by, key, F.lit(0).alias("e"), F.lit(1).alias("p")))
    items = sides.groupBy(*by, key).agg(F.max("e").alias("e"), F.max("p").alias("p"))
    counts = items.groupBy(*by).agg(F.sum("e").alias("expected"), F.sum("p").alias("predicted"), F.sum(F.col("e") * F.col("p")).alias("correct"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    scored = counts.withColumns({"precision": ratio(F.col("correct"), F.col("predicted")), "recall": ratio(F.col("correct"), F.col("expected"))})
    return scored.withColumn("f1", ratio(2 * F.col("correct"), F.col("expected") + F.col("predicted")))


def gates(metrics: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """Whether each named metric holds its bound: ``gate, value, bound, passed``."""
    rows = [(k, F.col(k) >= v, v) for k, v in least.items()] + [(k, F.col(k) <= v, v) for k, v in most.items()]
    made = F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("bound"), ok.alias("passed")) for k, ok, v in rows])
    return metrics.select(F.inline(made))


def compare(current: DataFrame, baseline: DataFrame, higher: list[str], lower: list[str]) -> DataFrame:
    """A full outer comparison of signals ``path, value``: regression, improvement or neutral by the path's policy."""
    both = current.withColumnRenamed("value", "current").join(baseline.withColumnRenamed("value", "baseline"), "path", "full_outer")
    starts = lambda names: F.coalesce(*[F.when(F.col("path").startswith(n), True) for n in names], F.lit(False)) if names else F.lit(False)
    up, down = F.col("current") > F.col("baseline"), F.col("current") < F.col("baseline")
    change = F.when(F.col("current").isNull(), "regression").when(F.col("baseline").isNull(), "neutral").when(F.col("current") == F.col("baseline"), "neutral")
    change = change.when(starts(higher), F.when(up, "improvement").otherwise("regression")).when(starts(lower), F.when(down, "improvement").otherwise("regression"))
    return both.withColumn("change", change.otherwise("regression"))
