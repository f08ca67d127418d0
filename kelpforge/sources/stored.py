"""Rows that several parts of a plan read, worked out once; rows dealt over all cores before costly work."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from .committed import shared_folder


def stored(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` as written to the shared folder: what reads them more than once reads files and does not work them out again."""
    path = f"{shared_folder(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def kept_together(rows: DataFrame, key: str, each: int) -> DataFrame:
    """``rows`` dealt by ``key`` into parts of about ``each`` rows, of which there are as many as a count asks for: what is grouped,
    sorted or joined by ``key`` then stays where it is, and a task's memory does not grow with the table."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))
    return rows.repartition(parts, key)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over all cores, for costly work on narrow ones: Spark cuts files by size, and a small file of many rows is one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
