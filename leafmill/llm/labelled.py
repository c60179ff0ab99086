"""A bounded sample of labelled rows, from which a classifier may learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Labelled rows that a classifier learns from at most; those with the smallest hash of their id are taken.
TRAIN_ROWS = 24_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, bound: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y) of up to `bound` labelled documents that aren't held out; of equal texts, one stays.

    labels (doc_id, label, ...): null labels and ids are left out; of a repeated id the largest label counts.
    """
    prepare(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).checkpoint()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return texts.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.min(F.struct("doc_id", "y", "text")).alias("r")).select("r.doc_id", "r.text", "r.y").checkpoint()
