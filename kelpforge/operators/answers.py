"""Answers to questions from published records: what is relevant, in which order, within which budget, in which state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import retrieval as Q
from .records import BLOCKING, PENDING

# Fixed values.
FOUND = "Encontrei nas fontes validadas: "
STATES = {
    "conflicting_sources": "Encontrei fontes publicadas conflitantes. E necessario resolver o conflito antes de responder.",
    "partial_answer": "Encontrei apenas parte da informacao nas fontes validadas.",
    "needs_human_validation": "Existe informacao relacionada, mas ela ainda nao foi validada por revisao humana.",
    "not_found": "Nao encontrei essa informacao nas fontes validadas.",
}
MISSING = {"partial_answer": "context_budget", "needs_human_validation": "human_validation", "not_found": "published_data"}


def matched_kinds(terms: Column) -> Column:
    """The kinds of records whose vocabulary a question's terms meet."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(terms, X.literals(words)), F.lit(kind)) for kind, words in X.INTENT_TERMS.items()]))


def relevant_pairs(questions: DataFrame, records: DataFrame, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """Each question with its relevant records and what they are ranked by.

    ``question_id, question`` and ``id, kind, text, entity, ...`` in. A pair meets by an equality join on a shared term or on
    the kind that the question asks for, so no question is held against all records; a record that names other entities
    than the question is left out. ``key`` is taken to be unique among the records; a question without terms has no pairs.
    """
    asked = questions.withColumn("_asked", X.terms(F.col("question"))).withColumn("_wanted", X.entity_terms(F.col("_asked")))
    held = records.withColumn("_own", X.terms(F.col("text"))).withColumn("_named", X.terms(F.coalesce("entity", F.lit(""))))
    by_term = asked.select("question_id", F.explode("_asked").alias("key")).join(held.select(*key, F.explode("_own").alias("key")), "key")
    by_kind = asked.select("question_id", F.explode(matched_kinds(F.col("_asked"))).alias("key")).join(held.select(*key, F.col("kind").alias("key")), "key")
    pairs = by_term.select("question_id", *key).union(by_kind.select("question_id", *key)).distinct()
    both = pairs.join(held, [*key]).join(asked.select("question_id", "_asked", "_wanted"), "question_id")
    special = X.entity_terms(F.col("_named"))
    mismatch = (F.size(special) > 0) & (F.size("_wanted") > 0) & ~F.arrays_overlap(special, "_wanted")
    scores = {"entity_matches": F.size(F.array_intersect("_wanted", "_named")), "intent": X.intent_matched(F.col("kind"), F.col("_asked")).cast("int"), "lexical": F.size(F.array_intersect("_asked", "_own"))}
    return both.where(~mismatch).withColumns(scores).drop("_own", "_named", "_asked", "_wanted")


def ranked_context(questions: DataFrame, records: DataFrame, most: int) -> DataFrame:
    """The first ``most`` facts and the first ``most`` rules of each question, ``rank`` counting facts before rules."""
    return _cut(relevant_pairs(questions, records), most, "record_class")


def _cut(pairs: DataFrame, most: int, *classes: str) -> DataFrame:
    own = Window.partitionBy("question_id", *classes).orderBy(*Q.ranking())
    cut = pairs.withColumn("_place", F.row_number().over(own)).where(F.col("_place") <= most)
    return cut.withColumn("rank", F.col("_place") + F.when(F.col("record_class") == "rule", most).otherwise(0)).drop("_place")


def evidence(used: DataFrame, spans: DataFrame, sources: DataFrame) -> DataFrame:
    """A row of evidence for each used record: its span's place and public quote, its source's name, its own chunk if the span has none."""
    quote = X.public_quote(F.col("quote"))
    held = spans.select("evidence_id", F.when(F.length(quote) > 500, F.concat(F.substring(quote, 1, 497), F.lit("..."))).otherwise(quote).alias("quote"), "page_number", F.col("chunk_id").alias("_chunk"))
    named = sources.select("source_id", F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("original_filename", "filename", "name", "title") if c in sources.columns]).alias("source_name"))
    full = used.join(held, "evidence_id", "left").join(named, "source_id", "left")
    only = lambda kind: F.when(F.col("record_class") == kind, F.col("id"))
    return full.select("question_id", "source_id", "source_name", "evidence_id", "quote", "page_number", F.coalesce("_chunk", "chunk_id").alias("chunk_id"), only("fact").alias("fact_id"), only("rule").alias("rule_id"))


def answers(questions: DataFrame, records: DataFrame, contradictions: DataFrame, unknowns: DataFrame, *, most: int, budget: int) -> DataFrame:
    """``question_id, answer_state, answer, confidence, facts_used, rules_used, sources_used, missing_data, warnings, tokens``.

    Records are those of published sources with ``record_class, status, rendered, tokens``; only published ones answer,
    pending ones and open unknowns ask for validation. A contradiction ``record_ids, source_ids, status`` that blocks and
    names a ranked record stops the answer. All kinds of records meet the questions in one pass. Within the budget records are taken greedily, facts before rules. A question
    gathers at most two times ``most`` records.
    """
    side = F.when(F.col("status") == "published", "published").when(F.col("status").isin(PENDING), "pending")
    known = records.withColumn("_side", side).where("_side IS NOT NULL").unionByName(unknowns.where("status = 'open'").withColumn("_side", F.lit("open")), allowMissingColumns=True)
    ranked = _cut(relevant_pairs(questions, known, ("_side", "id")), most, "_side", "record_class")
    told = F.array_sort(F.collect_set(F.struct("contradiction_id", "source_ids")))
    blocked = contradictions.where(F.col("status").isin(BLOCKING)).select(F.explode("record_ids").alias("id"), "contradiction_id", "source_ids").groupBy("id").agg(told.alias("_told")).withColumn("_side", F.lit("published"))
    item = F.when(F.col("_side") == "published", F.struct("rank", "id", "record_class", "source_id", "confidence", "rendered", "tokens"))
    met = ranked.join(blocked, ["_side", "id"], "left").groupBy("question_id")
    folded = met.agg(F.array_sort(F.collect_list(item)).alias("_all"), F.bool_or(F.col("_side") != "published").alias("_waits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_told")))).alias("_told"))
    begin = F.struct(F.lit(0).cast("long").alias("used"), F.filter("_all", lambda x: F.lit(False)).alias("taken"))

    def step(acc, x):
        total = acc["used"] + x["tokens"]
        return F.when(total <= budget, F.struct(total.alias("used"), F.concat(acc["taken"], F.array(x)).alias("taken"))).otherwise(acc)

    sources = F.when(F.size("_told") > 0, F.array_distinct(F.flatten(F.transform("_told", lambda x: x["source_ids"]))))
    fitted = folded.select("question_id", "_all", F.nullif("_waits", F.lit(False)).alias("_waits"), sources.alias("conflict_sources"), F.aggregate("_all", begin, step).alias("_fit"))
    joined = questions.select("question_id").join(fitted, "question_id", "left")
    taken = F.col("_fit.taken")
    n_all, n_fit = F.coalesce(F.size("_all"), F.lit(0)), F.coalesce(F.size(taken), F.lit(0))
    counts = {"candidates": F.greatest(n_all, F.lit(0)), "fitting": F.greatest(n_fit, F.lit(0)), "conflicts": F.col("conflict_sources").isNotNull().cast("int"), "pending": F.col("_waits").isNotNull().cast("int")}
    stated = Q.answer_state(joined.withColumns(counts))
    valid, state = F.col("answer_state") == "valid_answer", F.col("answer_state")
    facts, rules = F.filter(taken, lambda x: x["record_class"] == "fact"), F.filter(taken, lambda x: x["record_class"] == "rule")
    counted = F.concat(F.size(rules).cast("string"), F.lit(" regra(s) publicada(s) relacionada(s)."))
    said = F.concat(F.lit(FOUND), F.concat_ws(" ", F.when(F.size(facts) > 0, F.array_join(F.transform(facts, lambda x: x["rendered"]), "; ")), F.when(F.size(rules) > 0, counted)))
    none = F.array().cast("array<string>")
    ids = lambda found: F.when(valid, F.transform(found, lambda x: x["id"].cast("string"))).otherwise(none)
    seen = lambda found: F.array_distinct(F.filter(F.transform(found, lambda x: x["source_id"]), lambda s: s.isNotNull()))
    conflict = F.when(F.size("conflict_sources") > 0, F.col("conflict_sources")).otherwise(seen(F.col("_all")))
    return stated.select(
        "question_id", "answer_state", F.when(valid, said).otherwise(F.element_at(X.named(STATES), state)).alias("answer"),
        F.when(valid, F.coalesce(F.array_max(F.transform(taken, lambda x: x["confidence"])), F.lit(0.0))).otherwise(0.0).alias("confidence"),
        ids(facts).alias("facts_used"), ids(rules).alias("rules_used"), F.when(valid, seen(taken)).when(state == "conflicting_sources", conflict).otherwise(none).alias("sources_used"),
        F.coalesce(F.element_at(X.named(MISSING), state), F.lit("")).alias("missing_data"), F.when(state == "conflicting_sources", "conflict_requires_review").otherwise("").alias("warnings"),
        F.when(valid, F.least(F.lit(budget).cast("long"), F.col("_fit.used"))).otherwise(F.lit(0).cast("long")).alias("tokens"),
    )


def abstention_correct(expected: Column, answered: Column) -> Column:
    """Whether a question that has no answer was left open, and one that has was answered."""
    refused = answered.isin("not_found", "needs_human_validation")
    return F.when(expected == "abstain", refused).otherwise(~refused)
