"""Operators as pipeline stages: documents in, documents out, with the operators' decisions carried out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .exact_dedup import exact_duplicates
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .toxicity import score_toxicity


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids, null among them. The ids are few bytes each: the texts move once, unless Spark finds the ids small enough to broadcast."""
    return docs.join(ids.withColumnRenamed("doc_id", "own"), F.col("doc_id").eqNullSafe(F.col("own")), "left_semi").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the corpus's labels, does not call toxic."""
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _only(docs, scored.groupBy("doc_id").agg(F.max("predicted").alias("p")).filter("p = 0").select("doc_id").checkpoint())


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space. Rows that repeat a kept doc_id stay together."""
    return _only(docs, exact_duplicates(docs).filter("kept").select("doc_id").distinct().checkpoint())


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity of 0.8 or more."""
    return _only(docs, near_duplicates(docs, k=5, num=80, den=100).filter("kept").select("doc_id").distinct().checkpoint())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies, none for those that it passes over."""
    taken = mix_sources(docs).filter("copies > 0").groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies")).checkpoint().withColumnRenamed("doc_id", "own")
    joined = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("own")))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of documents but the text, with ids, their number and digests; encode_decode holds the decoded bytes against the text's own."""
    keys = [c for c in docs.columns if c != "text"]
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keys=keys, ids=True)
