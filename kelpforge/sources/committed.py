"""Tables that change together: rows are staged apart, and one rename makes them all visible.

A store is a folder that all machines share. Rows of a change lie in ``data/<table>/store_change=<number>/<stage>``; what it
replaces is a list of keys in ``staged/<stage>``, beside the names of the jobs it completes. The change counts once its list has been renamed to
``log/change=<number>``: one rename of one folder, which either happens or does not. Readers take the log, find for each table and key
the latest change that speaks of it, and join that to the rows; rows of changes that are not in the log are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = "table string, key string, number long, stage string"
JOBS = "__jobs__"
Rows = DataFrame | Callable[[dict[str, DataFrame]], DataFrame]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local one only where the session names none and runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    import tempfile

    return tempfile.mkdtemp(prefix="store-")


@dataclass
class Change:
    """What one commit does: of each table the keys it replaces and the rows they then have.

    Tables are written in the order they are named in. Rows may be given as a function of the tables written before, by name, so
    that what they count or join is read and not worked out again.
    """

    jobs: DataFrame
    replaces: dict[str, tuple[DataFrame | None, str, Rows]] = field(default_factory=dict)

    def replace(self, table: str, keys: DataFrame, key: str, rows: Rows) -> Change:
        """``keys`` (a column ``key``) lose what rows they had in ``table`` and get those of ``rows``, if any."""
        self.replaces[table] = (keys, key, rows)
        return self

    def append(self, table: str, key: str, rows: Rows) -> Change:
        """The keys of ``rows`` get them; the rows are computed once, and the keys are read from what was written."""
        self.replaces[table] = (None, key, rows)
        return self


class Store:
    """Versioned tables under one folder.

    One writer at a time: it numbers its change after the last one, and the rename fails if another has taken that number.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        return jvm, path.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf)

    def numbers(self) -> list[int]:
        """The numbers of the committed changes, one folder each."""
        jvm, files, _ = self._files()
        log = jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        if not files.exists(log):
            return []
        return sorted(int(x.getPath().getName().split("=")[1]) for x in files.listStatus(log) if x.getPath().getName().startswith("change="))

    def log(self, until: int | None = None) -> DataFrame:
        """``table, key, number, stage``: what each committed change has replaced, jobs among it."""
        numbers = [n for n in self.numbers() if until is None or n <= until]
        if not numbers:
            return self.spark.createDataFrame([], KEYS)
        return self.spark.read.schema(KEYS).parquet(*[f"{self.root}/log/change={n:012d}" for n in numbers])

    def done(self) -> DataFrame:
        """``key``: the jobs that are complete."""
        return self.log().where(F.col("table") == JOBS).select("key").distinct()

    def stage(self, change: Change) -> tuple[str, int]:
        """Writes what the change needs where no reader looks; the name and number to publish it by."""
        number, stage = max(self.numbers(), default=0) + 1, uuid.uuid4().hex
        keys = change.jobs.select(F.lit(JOBS).alias("table"), F.col("job_key").cast("string").alias("key"))
        written: dict[str, DataFrame] = {}
        for table, (replaced, key, made) in change.replaces.items():
            folder = f"{self.root}/data/{table}/store_change={number}/{stage}"
            rows = (made if isinstance(made, DataFrame) else made(written)).withColumn("_key", F.col(key).cast("string"))
            rows.write.parquet(folder)
            written[table] = self.spark.read.schema(rows.schema).parquet(folder)
            replaced = written[table] if replaced is None else replaced
            keys = keys.union(replaced.select(F.lit(table), F.col(key).cast("string")))
        keys.distinct().select("table", "key", F.lit(number).cast("long").alias("number"), F.lit(stage).alias("stage")).write.parquet(f"{self.root}/staged/{stage}")
        return stage, number

    def commit(self, change: Change) -> int:
        """Stages the change and makes it visible; its number. Until the rename readers are where they were."""
        stage, number = self.stage(change)
        self.publish(stage, number)
        return number

    def publish(self, stage: str, number: int) -> None:
        """The rename. It fails, and changes nothing, if the number is taken: the change has to be staged again on what is there now."""
        jvm, files, context = self._files()
        files.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{self.root}/log"))
        target = jvm.org.apache.hadoop.fs.Path(f"{self.root}/log/change={number:012d}")
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # no overwriting
        context.rename(jvm.org.apache.hadoop.fs.Path(f"{self.root}/staged/{stage}"), target, plain)

    def read(self, table: str, until: int | None = None) -> DataFrame:
        """The rows of ``table`` as of change ``until``, or now.

        The latest change of each key is found with map-side maxima and joined to its rows by key and number; only folders of
        committed changes are listed, and a change that spoke of keys without giving them rows has none to read.
        """
        mine = self.log(until).where(F.col("table") == table)
        changes = mine.select("number", "stage").distinct().collect()  # one a change
        if not changes:
            raise KeyError(table)
        folders = sorted(f"{self.root}/data/{table}/store_change={r.number}/{r.stage}" for r in changes)
        current = mine.groupBy(F.col("key").alias("_key")).agg(F.max("number").alias("_number"))
        rows = self.spark.read.option("basePath", f"{self.root}/data/{table}").parquet(*folders)
        numbered = rows.withColumn("_number", F.col("store_change").cast("long")).drop("store_change")
        return numbered.join(current, ["_key", "_number"], "left_semi").drop("_key", "_number")

    def compact(self, table: str, key: str) -> int:
        """Writes the rows of ``table`` as they are in one change, so that reading opens one folder's files again."""
        keys = self.log().where(F.col("table") == table).select(F.col("key").alias(key)).distinct()
        rows = self.read(table)
        return self.commit(Change(self.spark.createDataFrame([], "job_key string")).replace(table, keys, key, rows))


def fresh(store: Store, jobs: DataFrame) -> DataFrame:
    """Of ``jobs`` (``job_key`` ...) those that are not complete, one row a key."""
    return jobs.dropDuplicates(["job_key"]).join(store.done().withColumnRenamed("key", "job_key"), "job_key", "left_anti")


def complete_ingest(store: Store, jobs: DataFrame, reports: DataFrame, chunks: DataFrame) -> int | None:
    """Ingest jobs ``job_key, source_id`` completed as one change; None if none was open.

    Each source's quality report and chunks are replaced (a source without new chunks keeps none), the source counts as
    ``processing``, the job as ``succeeded`` with the number of its chunks.
    """
    open_ = fresh(store, jobs.select(F.col("job_key").cast("string").alias("job_key"), "source_id")).cache()
    try:
        if open_.isEmpty():
            return None
        sources = open_.select("source_id").distinct()
        passed = F.coalesce("passed", F.lit(True))
        decision = F.when(passed, "passed").otherwise(F.coalesce("rejection_reason", F.lit("failed")))
        judged = reports.join(sources, "source_id", "left_semi").dropDuplicates(["source_id"]).select("source_id", passed.alias("is_processable"), F.coalesce("warnings", F.lit("")).alias("detected_issues"), decision.alias("decision"))
        cut = chunks.join(sources, "source_id", "left_semi").withColumn("status", F.lit("pending"))
        states = sources.select("source_id", F.lit("processing").alias("status"))

        def ended(written):
            counted = written["chunks"].groupBy("source_id").agg(F.count("*").alias("chunks_created"))
            return open_.join(counted, "source_id", "left").select("job_key", "source_id", F.lit("ingest").alias("kind"), F.lit("succeeded").alias("status"), F.coalesce("chunks_created", F.lit(0)).alias("records"))

        change = Change(open_).replace("quality_reports", sources, "source_id", judged).replace("chunks", sources, "source_id", cut)
        return store.commit(change.replace("sources", sources, "source_id", states).replace("jobs", open_, "job_key", ended))
    finally:
        open_.unpersist()


def complete_classification(store: Store, jobs: DataFrame, decisions: DataFrame, unknown: DataFrame, queued: DataFrame) -> int | None:
    """Classification jobs ``job_key, source_id, chunk_id`` completed as one change.

    ``decisions`` (``chunk_id, status, classification``) become the chunks' states, ``unknown`` (``chunk_id, raw_text, suggested_type,
    confidence``) their unknown items, ``queued`` (``chunk_id, job_key``) new extraction jobs; a key that is there already stays as it is.
    """
    open_ = fresh(store, jobs.select(F.col("job_key").cast("string").alias("job_key"), "source_id", "chunk_id")).cache()
    try:
        if open_.isEmpty():
            return None
        chunk = open_.select("chunk_id").distinct()
        own = lambda rows: rows.join(chunk, "chunk_id", "left_semi")
        known = store.log().where(F.col("table") == "jobs").select(F.col("key").alias("job_key"))
        asked = own(queued).select(F.col("job_key").cast("string").alias("job_key"), "chunk_id").dropDuplicates(["job_key"]).join(known, "job_key", "left_anti").join(open_.select("chunk_id", "source_id").dropDuplicates(["chunk_id"]), "chunk_id").cache()
        made = asked.groupBy("chunk_id").agg(F.count("*").alias("records"))
        row = lambda rows, kind, status, n: rows.select("job_key", "source_id", F.lit(kind).alias("kind"), F.lit(status).alias("status"), n.cast("long").alias("records"))
        ended = row(open_.join(made, "chunk_id", "left"), "classification", "succeeded", F.coalesce("records", F.lit(0))).union(row(asked, "extraction", "queued", F.lit(0)))
        change = Change(open_).replace("chunk_states", chunk, "chunk_id", own(decisions).dropDuplicates(["chunk_id"])).replace("unknown_items", chunk, "chunk_id", own(unknown))
        try:
            return store.commit(change.append("jobs", "job_key", ended))
        finally:
            asked.unpersist()
    finally:
        open_.unpersist()


def complete_extraction(store: Store, jobs: DataFrame, decisions: DataFrame, evidence: DataFrame, records: DataFrame, unknown: DataFrame) -> int | None:
    """Extraction jobs ``job_key, source_id, chunk_id`` completed as one change.

    ``records`` (``job_key, kind, type, payload, confidence``) are facts and rules with the job's ``evidence`` (``job_key, quote, char_start,
    char_end``), ``unknown`` (``job_key, raw_text``) what could not be read; ``decisions`` (``job_key, status``) the chunks' new states. The job
    tells how many records it made.
    """
    open_ = fresh(store, jobs.select(F.col("job_key").cast("string").alias("job_key"), "source_id", "chunk_id")).cache()
    try:
        if open_.isEmpty():
            return None
        key = open_.select("job_key")
        own = lambda rows: rows.withColumn("job_key", F.col("job_key").cast("string")).join(key, "job_key", "left_semi")
        spans = own(evidence).dropDuplicates(["job_key"]).withColumn("evidence_id", F.sha2(F.concat_ws(":", "job_key", "quote"), 256))

        def found(written):
            return own(records).join(written["evidence"].select("job_key", "evidence_id"), "job_key", "left").withColumn("status", F.lit("extracted"))

        def ended(written):
            made = written["records"].groupBy("job_key").agg(F.count("*").alias("records"))
            return open_.join(made, "job_key", "left").select("job_key", "source_id", F.lit("extraction").alias("kind"), F.lit("succeeded").alias("status"), F.coalesce("records", F.lit(0)).alias("records"))

        chunk = open_.select("chunk_id").distinct()
        states = own(decisions).join(open_.select("job_key", "chunk_id"), "job_key").dropDuplicates(["chunk_id"]).select("chunk_id", "status")
        unsaid = store.log().where(F.col("table") == "chunk_states").isEmpty()
        held = states.withColumn("classification", F.lit(None).cast("string")) if unsaid else states.join(store.read("chunk_states").select("chunk_id", "classification"), "chunk_id", "left")
        change = Change(open_).replace("evidence", key, "job_key", spans).replace("records", key, "job_key", found).replace("extraction_unknown", key, "job_key", own(unknown))
        return store.commit(change.replace("chunk_states", chunk, "chunk_id", held).replace("jobs", open_, "job_key", ended))
    finally:
        open_.unpersist()
