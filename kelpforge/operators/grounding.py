"""Classification routing and grounding: what a model said is checked before anything else sees it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..sources.committed import Change, Store

# Fixed values.
PASSES, LEAST = 0.75, 0.30
FACT_TYPES = [
    "service_price", "business_hours", "payment_method", "contact_info", "faq_item", "controlled_document_metadata",
    "industrial_requirement", "industrial_responsibility", "industrial_relation",
]
RULE_TYPES = ["discount_rule", "cancellation_policy"]
ALIASES = {
    "procedure": "industrial_requirement", "requirement": "industrial_requirement", "definition": "industrial_requirement", "deadline": "industrial_requirement",
    "acceptance_criteria": "industrial_requirement", "mandatory_record": "industrial_requirement", "approval": "industrial_requirement", "training": "industrial_requirement",
    "audit": "industrial_requirement", "calibration": "industrial_requirement", "responsibility": "industrial_responsibility", "related_form": "industrial_relation",
    "references_document": "industrial_relation", "process_step": "industrial_relation",
}
STAKES = {
    "default": (["business_rules", "service_price"], ["business_hours", "payment_method", "contact_info", "faq_item"]),
    "industrial": (["business_rules", "service_price", "controlled_document_metadata", "industrial_requirement"], ["industrial_responsibility", "industrial_relation"]),
}


def verify_quote(rows: DataFrame) -> DataFrame:
    """Whether ``quote`` is literal text of ``chunk``, at ``char_start`` and ``char_end`` if these are given.

    Typographic quotation marks and white space are made alike first. Adds status, reason, match_mode, offset_status,
    found_start and found_end. A quote that occurs more than once passes, but is marked ambiguous.
    """
    quote, chunk = X.canonical_quote(F.coalesce("quote", F.lit(""))), X.canonical_quote(F.coalesce("chunk", F.lit("")))
    base = rows.withColumns({"_q": quote, "_c": chunk, "_raw": F.coalesce("chunk", F.lit(""))})
    start, end, n = F.col("char_start"), F.col("char_end"), F.length("_raw")
    given = start.isNotNull() | end.isNotNull()
    cut = F.substr("_raw", start + 1, end - start)
    wrong = (
        F.when(F.col("_q") == "", "empty evidence quote")
        .when(given & (start.isNull() | end.isNull()), "incomplete offsets")
        .when(given & ((start < 0) | (end < 0)), "negative offsets")
        .when(given & (start >= end), "invalid offset ordering")
        .when(given & ((start > n) | (end > n)), "offsets out of range")
        .when(given & (X.canonical_quote(cut) != F.col("_q")), "slice does not match")
        .when(~given & ~F.contains(F.col("_c"), F.col("_q")), "quote not found")
    )
    judged = base.withColumn("reason", wrong)
    ok = F.col("reason").isNull()
    second = F.expr("locate(_q, _c, locate(_q, _c) + 1)")
    first_raw = F.expr("locate(_q, _raw)")
    once = (first_raw > 0) & (F.expr("locate(_q, _raw, locate(_q, _raw) + 1)") == 0)
    return judged.select(
        *rows.columns,
        F.when(ok, "passed").otherwise("failed").alias("status"),
        "reason",
        F.when(ok, F.when(given & (cut == F.col("quote")), "exact").otherwise("normalized")).alias("match_mode"),
        F.when(ok, F.when(given, "offsets_verified").when(second > 0, "ambiguous_substring_without_offsets").otherwise("substring_without_offsets")).alias("offset_status"),
        F.when(ok, F.when(given, start).when(once, first_raw - 1)).cast("long").alias("found_start"),
        F.when(ok, F.when(given, end).when(once, first_raw - 1 + F.length("_q"))).cast("long").alias("found_end"),
    )


def decisions(labels: DataFrame) -> DataFrame:
    """A decision for each label ``chunk_id, classification, confidence, reason`` of a model, and where it goes.

    Unsupported labels go to the unknown queue; a known type below LEAST is dropped; one below PASSES waits in the
    queue. A null classification stands for a response without labels.
    """
    named = labels.withColumn("kind", F.lower(F.trim("classification")))
    named = named.withColumn("kind", F.coalesce(F.element_at(X.named(ALIASES), F.col("kind")), F.col("kind")))
    known = F.col("kind").isin(*FACT_TYPES, *RULE_TYPES)
    passes = known & (F.col("confidence") >= PASSES)
    kept = named.where(F.col("kind").isNull() | ~known | (F.col("confidence") >= LEAST))
    goes = F.when(passes & F.col("kind").isin(FACT_TYPES), "extracted_facts").when(passes, "business_rules").otherwise("unknown_facts_queue")
    why = F.when(F.col("kind").isNull(), "empty_classifications").when(~known & (F.col("kind") != "unknown"), F.concat(F.lit("unsupported_classification: "), F.coalesce("reason", F.lit("")))).otherwise(F.col("reason"))
    what = F.when(F.col("kind").isNull(), "unknown").when(~known & (F.col("kind") != "unknown"), F.col("classification")).otherwise(F.col("kind"))
    return kept.select("chunk_id", what.alias("fact_type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), why.alias("reason"), goes.alias("destination"), F.coalesce(passes, F.lit(False)).alias("passes"))


def chunk_status(decided: DataFrame) -> DataFrame:
    """Classified if any decision passes, else to be reviewed."""
    return decided.groupBy("chunk_id").agg(F.when(F.bool_or("passes"), "classified").otherwise("needs_review").alias("status"))


def stakes(kind, profile: str = "default"):
    """Column: required, warn_only or not_configured; rule types count as business rules, unknown profiles as the default."""
    required, warned = STAKES.get(profile, STAKES["default"])
    name = F.when(kind.isin(RULE_TYPES), "business_rules").otherwise(kind)
    return F.when(name.isin(required), "required").when(name.isin(warned), "warn_only").otherwise("not_configured")


def classify(chunks: DataFrame, model: Callable[[list[str]], list[list[dict]]]) -> DataFrame:
    """``chunk_id, classification, confidence, reason`` from a model, asked once for each distinct text.

    Chunks in which an injection is suspected never reach the model. ``model`` takes a batch of texts.
    """
    marked = chunks.select("chunk_id", "text", F.sha2("text", 256).alias("key"), (F.size(X.injection_matches(F.col("text"))) > 0).alias("suspect"))
    schema = "key string, classification string, confidence double, reason string"

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, x.get("classification"), float(x.get("confidence") or 0.0), x.get("reason")) for k, found in zip(frame["key"], model(frame["text"].tolist()), strict=True) for x in (found or [{}])]
            yield pd.DataFrame(rows, columns=["key", "classification", "confidence", "reason"])

    asked = marked.where("NOT suspect").groupBy("key").agg(F.first("text").alias("text")).mapInPandas(ask, schema)
    said = marked.where("NOT suspect").select("chunk_id", "key").join(asked, "key").drop("key")
    stopped = marked.where("suspect").select("chunk_id", F.lit("unknown").alias("classification"), F.lit(0.0).alias("confidence"), F.lit("injection_suspected").alias("reason"))
    return said.unionByName(stopped)


def _keyed(claims: DataFrame, profile: str) -> DataFrame:
    checked = verify_quote(claims).withColumn("mode", stakes(F.col("fact_type"), profile))
    return checked.withColumn("grounding_key", V.grounding_key(F.col("fact_type"), F.col("claim"), F.coalesce("quote", F.lit("")), F.lit("v1"), F.lit("model")))


def _asked(keyed: DataFrame, verdicts: Callable[[list[dict]], list[str]], known: DataFrame | None) -> DataFrame:
    """``grounding_key, said`` of the distinct claims that need a verdict and have none in ``known``."""
    asking = keyed.where((F.col("status") == "passed") & (F.col("mode") != "not_configured")).groupBy("grounding_key").agg(F.first(F.struct("fact_type", "claim", "chunk", "quote")).alias("claim"))
    if known is not None:
        asking = asking.join(known.select("grounding_key"), "grounding_key", "left_anti")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"grounding_key": frame["grounding_key"], "said": verdicts([dict(x) for x in frame["claim"]])})

    return asking.mapInPandas(ask, "grounding_key string, said string")


def _routed(keyed: DataFrame, said: DataFrame) -> DataFrame:
    entailment = F.when(F.col("mode") == "not_configured", "not_required").when(F.col("status") == "failed", "failed")
    entailment = entailment.when(F.col("said").isin("supported", "passed"), "passed").when(F.col("said").isin("contradicted", "failed", "unsupported"), "failed").otherwise("abstained")
    out = keyed.join(said, "grounding_key", "left").withColumn("entailment", entailment)
    return out.withColumn("blocks", (F.col("mode") == "required") & F.col("entailment").isin("failed", "abstained")).drop("said")


def grounded(claims: DataFrame, verdicts: Callable[[list[dict]], list[str]], profile: str = "default") -> DataFrame:
    """Check by text, then, where stakes ask for it, a model's verdict, once for each grounding key.

    ``claim_id, fact_type, claim, chunk, quote, char_start, char_end`` in. ``blocks`` marks required claims that failed
    or on which the model abstained.
    """
    keyed = _keyed(claims, profile)
    return _routed(keyed, _asked(keyed, verdicts, None))


def grounded_once(store: Store, claims: DataFrame, verdicts: Callable[[list[dict]], list[str]], profile: str = "default") -> DataFrame:
    """As ``grounded``, with verdicts kept in the table ``verdicts`` of a store: a key is asked for once, in whatever run.

    New verdicts are committed before they are used, so that a run that is repeated after a loss asks only for what is missing.
    """
    keyed = _keyed(claims, profile)
    known = store.read("verdicts") if not store.log().where(F.col("table") == "verdicts").isEmpty() else None
    said = _asked(keyed, verdicts, known)
    stage, number = store.stage(Change(claims.sparkSession.createDataFrame([], "job_key string")).append("verdicts", "grounding_key", said))
    store.publish(stage, number)
    return _routed(keyed, store.read("verdicts"))
