"""Corpus pipeline: toxicity, exact dedup, near dedup, mixing, byte-level BPE.

Each stage takes what its predecessor kept, as Parquet that was written and read again; its decisions take effect. All
but the last return the columns of documents. The folder for the tables between stages is spark.checkpoint.dir.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import stages
from leafmill.llm.common import prepare
from leafmill.sources.files import Folder

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("exact_dedup", stages.drop_exact),
    ("near_dedup", stages.drop_near),
    ("mixing", stages.mix),
    ("byte_bpe", stages.encode),
]

#: SQL expresses neither the toxicity model nor the BPE merges; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's result, not yet written. Of the tables between stages only the one that it reads is left behind."""
    prepare(spark)
    folder = Folder(spark, f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(folder.path(name))
        docs = spark.read.parquet(folder.path(name))
        if before is not None:
            folder.delete(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
