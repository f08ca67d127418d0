"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a regular expression that Java and RE2 read alike.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local one only where the session names none (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir().get()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*written: DataFrame) -> None:
    """Removes what ``materialize`` wrote, once nothing that is still to be computed reads it."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: The most bits of a filter of keys (8 MB).
FILTER_BITS = 26


def join_few(rows: DataFrame, few: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``few``, a stored table with the long ``key``, without shuffling rows that have no partner.

    The keys of ``few`` are marked in a bitmap of FILTER_BITS bits at most, whose pieces of 4 KB are broadcast. Only rows
    whose bit is set go through the join's shuffle; the others, for a left join, keep nulls. Null keys have no partner.
    """
    bits = min(FILTER_BITS, max(15, (16 * few.count()).bit_length()))
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << bits))
    marks = few.where(F.col(key).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("_piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_marks"))
    spot = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.expr("substring(_marks, CAST(_spot DIV 8 + 1 AS INT), 1)")), 16, 10).cast("int")
    placed = rows.withColumns({"_piece": F.bitmap_bucket_number(at), "_spot": spot}).join(F.broadcast(marks), "_piece", "left")
    marked = placed.withColumn("_met", F.coalesce(F.getbit(byte, (F.col("_spot") % 8).cast("int")) == 1, F.lit(False)))
    met = marked.where("_met").select(*rows.columns).join(few, key, how)
    if how == "inner":
        return met
    apart = marked.where("NOT _met").select(*rows.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in few.schema if f.name != key])
    return met.select(*apart.columns).unionByName(apart)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into small ones, so that few rows and bytes at a time become Python objects.

    A batch of several rows has about ``most`` bytes at most; a longer row comes alone.
    """
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * most // max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            part, todo = batch.slice(start, step), []
            todo.append(part)
            while todo:
                part = todo.pop()
                if part.num_rows > 1 and part.nbytes > 2 * most:
                    half = part.num_rows // 2
                    todo += [part.slice(half), part.slice(0, half)]
                else:
                    yield part
