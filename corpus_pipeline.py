"""The corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packing.

Every stage takes the documents its predecessor kept and works on all of them; all but the last return the columns of
``documents``. ``run`` writes each stage's result to the shared folder and reads it again, as a caller may.
"""

from __future__ import annotations

from kelpforge.llm import chunking, packing, quality, secrets, simhash
from kelpforge.llm.common import materialize


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the rules, without the boilerplate lines of their source."""
    return quality.stage(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of linked fingerprints."""
    return simhash.stage(docs)


def repeated_passages(spark, docs, sf_dir):
    """Documents without passages that an earlier document has."""
    return chunking.stage(docs)


def secret_scan(spark, docs, sf_dir):
    """Documents with their secrets replaced."""
    return secrets.stage(docs)


def pack(spark, docs, sf_dir):
    """The pieces of all documents that are left, packed into sequences."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Fingerprints, gear hashes and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
