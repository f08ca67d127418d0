"""Predictions gathered from live tables, and what there is of one source, read from files clustered by source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import trees

PREDICTION = ["id", "source_id", "source_filename", "record_kind", "type", "content", "normalized_content", "canonical", "evidence_quote", "status"]
# The states in which an unknown item waits.
WAITING = ["open", "schema_requested"]


def _said(column: str) -> Column:
    """Whether JSON text says anything."""
    return ~F.coalesce(F.trim(column), F.lit("")).isin("", "{}", "[]", '""', "null", "false", "0")


def live(published: DataFrame, records: DataFrame) -> DataFrame:
    """The rows of the published view or, if it has none at all, the published ones of the table itself."""
    kept = [c for c in published.columns if c in records.columns]
    return published.select(*kept).unionByName(records.where((F.col("status") == "published") & ~published.select(F.lit(1)).exists()).select(*kept))


def exported(facts: DataFrame, rules: DataFrame, unknowns: DataFrame, sources: DataFrame) -> DataFrame:
    """Predictions of published facts and rules and of unknown items that wait, with the text that their payload comes to.

    Facts are ``id, source_id, fact_type, content, normalized_content, evidence_quote, status``, rules have ``rule_type, condition, action``,
    unknown items ``suggested_fact_type, metadata``, sources ``id, original_filename``; payloads are JSON. Records that say nothing
    are left out. Empty tables give no rows; a record whose source is not there has an empty file name.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quote = F.coalesce("evidence_quote", F.lit(""))
    of_facts = facts.where(_said("normalized_content") | _said("content") | (quote != "")).select(
        text("id").alias("id"), text("source_id").alias("source_id"), F.lit("fact").alias("record_kind"), text("fact_type").alias("type"), F.coalesce("content", F.lit("{}")).alias("content"),
        F.coalesce("normalized_content", F.lit("{}")).alias("normalized_content"), "evidence_quote", "status", F.lit(None).cast("string").alias("reason"),
    )
    both = F.concat(F.lit('{"condition":'), F.coalesce("condition", F.lit("{}")), F.lit(',"action":'), F.coalesce("action", F.lit("{}")), F.lit("}"))
    of_rules = rules.where(_said("condition") | _said("action") | (quote != "")).select(
        text("id").alias("id"), text("source_id").alias("source_id"), F.lit("rule").alias("record_kind"), text("rule_type").alias("type"), both.alias("content"), F.lit("{}").alias("normalized_content"), "evidence_quote", "status",
        F.lit(None).cast("string").alias("reason"),
    )
    kind = F.coalesce("suggested_fact_type", F.lit(""))
    reason = F.coalesce(F.nullif(F.get_json_object("metadata", "$.reason"), F.lit("")), F.nullif(kind, F.lit("")), F.lit("unknown"))
    signal = F.to_json(F.struct(reason.alias("reason"), kind.alias("suggested_fact_type"), text("status").alias("status")))
    of_unknowns = unknowns.where(F.col("status").isin(WAITING)).select(
        text("id").alias("id"), text("source_id").alias("source_id"), F.lit("review_signal").alias("record_kind"), F.lit("unknown_facts_queue").alias("type"), signal.alias("content"), F.lit("{}").alias("normalized_content"),
        F.lit("").alias("evidence_quote"), F.lit("published").alias("status"), reason.alias("reason"),
    )
    rows = of_facts.unionByName(of_rules).unionByName(of_unknowns).withColumn("record", F.concat_ws(":", "record_kind", "id"))
    told = rows.where("record_kind <> 'review_signal'")
    texts = lambda c: trees.canonical_text(told.where(_said(c)).select("record", c), c, "record").withColumnRenamed("canonical", c + "_text")
    named = sources.select(text("id").alias("source_id"), F.coalesce("original_filename", F.lit("")).alias("source_filename"))
    full = rows.join(texts("normalized_content"), "record", "left").join(texts("content"), "record", "left").join(named, "source_id", "left")
    canonical = F.coalesce("reason", F.nullif("normalized_content_text", F.lit("")), "content_text", F.lit(""))
    done = full.withColumns({"canonical": canonical, "source_filename": F.coalesce("source_filename", F.lit("")), "evidence_quote": quote, "status": F.coalesce("status", F.lit("published"))})
    return done.select(*PREDICTION)


def source_counts(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Rows of each table for each source: ``keys`` and a column a table, zero where there are none. One shuffle for all tables."""
    out = None
    for name, rows in tables.items():
        one = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("table_name") == name, F.col("n"))), F.lit(0)).alias(name) for name in tables])


@dataclass(frozen=True)
class Clustered:
    """Tables under one shared folder in directories by workspace and by bucket of the source, each file sorted by source.

    What is asked of one source reads one directory, and of its files the row groups that can hold it. Spark rebalances directories
    when they are written, so a source that holds most rows has many files and no task of its own.
    """

    root: str
    buckets: int = 64

    def _bucket(self, source: Column) -> Column:
        return F.pmod(F.xxhash64(source), F.lit(self.buckets)).cast("int")

    def write(self, table: str, rows: DataFrame) -> None:
        """``rows`` (``workspace_id, source_id, ...``) replace the table."""
        dealt = rows.withColumn("bucket", self._bucket(F.col("source_id").cast("string")))
        dealt = dealt.hint("rebalance", "workspace_id", "bucket").sortWithinPartitions("workspace_id", "bucket", "source_id")
        dealt.write.mode("overwrite").partitionBy("workspace_id", "bucket").parquet(f"{self.root}/{table}_{self.buckets}")
        dealt.limit(0).write.mode("overwrite").parquet(f"{self.root}/{table}_columns")  # an empty table has no files that tell its columns, and names of directories have no types

    def read(self, spark: SparkSession, table: str, workspace, source) -> DataFrame:
        """The rows of one source; the bucket is a constant of the plan, so other directories are not listed in its scan."""
        bucket = self._bucket(F.lit(source).cast("string"))
        columns = spark.read.parquet(f"{self.root}/{table}_columns").schema
        found = spark.read.schema(columns).parquet(f"{self.root}/{table}_{self.buckets}")
        return found.where((F.col("workspace_id") == F.lit(workspace)) & (F.col("bucket") == bucket) & (F.col("source_id") == F.lit(source))).drop("bucket")

    def report(self, spark: SparkSession, tables: list[str], workspace, source) -> DataFrame:
        """``table_name, rows`` of one source, a row a table."""
        out = None
        for name in tables:
            one = self.read(spark, name, workspace, source).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
            out = one if out is None else out.unionByName(one)
        return out
