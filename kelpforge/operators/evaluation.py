"""Predictions held against what was expected: within the scope of the truth, with what must not be there, by modality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoped(predictions: DataFrame, truth: DataFrame, scope: list[str]) -> DataFrame:
    """The predictions of which the truth speaks: those that share all columns of ``scope`` with some row of it.

    The truth's keys are made distinct first, so that frequent ones are shuffled once a task.
    """
    return predictions.join(truth.select(*scope).distinct(), scope, "left_semi")


def confusion(cases: DataFrame, modality: str = "modality") -> DataFrame:
    """``modality, cases, false_pass, false_fail, false_fail_rate, accuracy`` of ``expected`` and ``actual`` (passed or failed).

    One row a modality and one, with a null, over all. A case without modality counts as ``unspecified``.
    """
    named = cases.withColumn(modality, F.coalesce(F.col(modality), F.lit("unspecified")))
    expected, actual = F.col("expected"), F.col("actual")
    counts = named.rollup(modality).agg(
        F.count("*").alias("cases"),
        F.count_if((expected == "failed") & (actual == "passed")).alias("false_pass"),
        F.count_if((expected == "passed") & (actual == "failed")).alias("false_fail"),
        F.count_if(expected == "passed").alias("must_pass"),
        F.count_if(expected == actual).alias("correct"),
    )
    rate = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    return counts.select(modality, "cases", "false_pass", "false_fail", rate("false_fail", "must_pass").alias("false_fail_rate"), rate("correct", "cases").alias("accuracy"))


def expectations(expected: DataFrame, observed: DataFrame, by: list[str]) -> DataFrame:
    """Of expectations ``key, code, negative`` how many hold against what was ``observed`` (``key, code``), for each group ``by``.

    A negative one holds if the code was not observed for the key, also if nothing was observed of it at all.
    """
    seen = observed.select("key", "code").distinct().withColumn("seen", F.lit(True))
    met = F.coalesce("seen", F.lit(False)) != F.col("negative")
    joined = expected.join(seen, ["key", "code"], "left").withColumn("met", met)
    count = lambda condition, name: F.count_if(condition).alias(name)
    negative: Column = F.col("negative")
    return joined.groupBy(*by).agg(count(~negative, "positives"), count(~negative & F.col("met"), "hits"), count(negative, "negatives"), count(negative & F.col("met"), "passes"))
