"""The read path: queries rewritten with the corpus's own terms, steps with defaults, golden cases and their averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import kept_together

# Fixed values.
STRATEGY, MAX_CHUNKS, MAX_TOKENS = "SEMANTIC", 4, 2400
#: A term of the index has at most so many words.
TERM_WORDS = 4
#: An index with more entries is not broadcast.
SMALL_INDEX = 100_000
#: Queries that are rewritten in one task.
REWRITTEN = 65_536


def normalized(query: Column) -> Column:
    """Trimmed, white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(query, r"(?U)\s+", " ")))


def with_term(query: Column, user: Column, corpus: Column) -> Column:
    """The query with the corpus's term in the user's place, or after its end if the user's term does not occur."""
    added = F.when(F.contains(query, corpus), query).otherwise(F.concat(query, F.lit(" "), corpus))
    return F.when((user == "") | ~F.contains(query, user), added).otherwise(F.replace(query, user, corpus))


def small(index: DataFrame) -> DataFrame:
    """An index of up to SMALL_INDEX entries goes to all tasks; a longer one meets the queries' runs of words by a shuffle. Spark itself
    would take the file of the queries for the small side, and does not know that each query becomes many runs."""
    few = index.limit(SMALL_INDEX + 1).count() <= SMALL_INDEX
    return F.broadcast(index) if few else index.hint("merge")


def matches(queries: DataFrame, index: DataFrame, *, published_only: bool) -> DataFrame:
    """``query_id, score, entity_id, corpus_term, user_term`` for each entry whose user term is a run of words of the query.

    An equality join on runs of up to TERM_WORDS words, so that no query is held against the whole index; entries with longer
    or empty terms have no match here. Terms that repeat in a query count once.
    """
    shown = index.where("published") if published_only else index
    terms = small(shown).select("score", "entity_id", normalized(F.col("corpus_term")).alias("corpus_term"), normalized(F.col("user_term")).alias("user_term")).where("user_term <> ''")
    words = F.split(normalized(F.col("query")), " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_w")), lambda at: F.transform(F.sequence(F.lit(1), F.lit(TERM_WORDS)), lambda n: F.array_join(F.slice("_w", at, n), " "))))
    asked = queries.select("query_id", words.alias("_w")).select("query_id", F.explode(F.array_distinct(runs)).alias("user_term"))
    return asked.join(terms, "user_term").select("query_id", "score", "entity_id", "corpus_term", "user_term")


def transformed(queries: DataFrame, index: DataFrame, *, corpus_id: str, version: str, published_only: bool = True, low_recall: float = 0.5) -> DataFrame:
    """``query_id, rewritten, grounded, alternatives, cache_key`` of each query ``query_id, query, recall``.

    Matches are applied one after another in the order of falling score, then entity, corpus term and user term. Alternatives
    stand only where the recall is below ``low_recall``; a null recall asks for none. Null queries are empty ones. A query
    gathers only the matches of its own words, in the task it was dealt to.
    """
    queries = kept_together(queries, "query_id", REWRITTEN)
    order = F.struct((-F.col("score")).alias("less"), "entity_id", "corpus_term", "user_term")
    ordered = matches(queries, index, published_only=published_only).groupBy("query_id").agg(F.array_sort(F.collect_list(order)).alias("_found"))
    base = queries.withColumn("rewritten", normalized(F.coalesce("query", F.lit("")))).join(ordered, "query_id", "left")
    found = F.coalesce("_found", F.filter(F.array(F.struct(F.lit(0.0).alias("less"), F.lit("").alias("entity_id"), F.lit("").alias("corpus_term"), F.lit("").alias("user_term"))), lambda x: F.lit(False)))
    held = base.withColumn("_found", found)
    folded = normalized(F.aggregate("_found", F.col("rewritten"), lambda q, m: with_term(q, m["user_term"], m["corpus_term"])))
    other = F.array_distinct(F.filter(F.transform("_found", lambda m: normalized(with_term(F.col("rewritten"), m["user_term"], m["corpus_term"]))), lambda x: (x != "") & (x != F.col("rewritten"))))
    none = F.array().cast("array<string>")
    key = F.concat(F.lit(f"{corpus_id}:{version}:{'published' if published_only else 'all'}:"), F.col("rewritten"))
    return held.select("query_id", "rewritten", folded.alias("grounded"), F.when(F.col("recall") < low_recall, other).otherwise(none).alias("alternatives"), key.alias("cache_key"))


def steps(drafts: DataFrame, made: DataFrame) -> DataFrame:
    """Steps of a plan from drafts ``plan_id, position, query_id, step_id, strategy, required, max_chunks, max_tokens`` with the defaults filled in.

    Positions count from 0 within a plan and name the steps that have no name; a chunk budget is taken or left as a whole.
    """
    given = F.col("max_chunks").isNotNull() | F.col("max_tokens").isNotNull()
    return drafts.join(made, "query_id").select(
        "plan_id", F.coalesce("step_id", F.concat(F.lit("s"), (F.col("position") + 1).cast("string"))).alias("step_id"), F.coalesce("strategy", F.lit(STRATEGY)).alias("strategy"), F.col("grounded").alias("query"),
        F.coalesce("required", F.lit(True)).alias("required"), F.when(given, F.col("max_chunks")).otherwise(MAX_CHUNKS).alias("max_chunks"), F.when(given, F.col("max_tokens")).otherwise(MAX_TOKENS).alias("max_tokens"), "cache_key",
    )


def golden_report(cases: DataFrame) -> DataFrame:
    """Means of the measures of all cases in one row; zero where there is no case."""
    names = ["recall_at_k", "mrr", "citation_accuracy", "abstention_correctness"]
    return cases.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names])


def promoted(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """Golden cases from labels ``label_id, query, verdict`` and reviews ``label_id, chunk_ids, quotes``; unknown labels keep their reason."""
    return reviews.join(labels, "label_id", "left").select(
        "label_id", "query", F.col("chunk_ids").alias("expected_chunk_ids"), F.col("quotes").alias("expected_quotes"), F.col("verdict").alias("expected_verdict"), F.when(F.col("query").isNull(), "label_not_found").alias("reason")
    )
