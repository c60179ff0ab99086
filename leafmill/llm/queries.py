"""Driver queries op1 to op10 and their SQL. Each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, mixing, url_cascade
from .avi import media_features
from .bpe import encode_decode
from .common import documents
from .exact_dedup import exact_duplicates
from .licences import scan_licences
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .quality import score_quality
from .token_counts import count_tokens
from .toxicity import score_toxicity
from .url_cascade import judge_urls


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, links at 100 * |both| >= 85 * |either|."""
    return near_duplicates(documents(spark, sf_dir), k=3, num=85, den=100).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), _labels(spark, sf_dir))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(documents(spark, sf_dir))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), _labels(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


_all = (op1_minhash_near_dedup, op2_exact_dedup, op3_mixing, op4_token_counts, op5_quality, op6_media, op7_url_filters, op8_licences, op9_toxicity, op10_byte_bpe)
QUERIES = {f.__name__: f for f in _all}
ORACLE = {"op2_exact_dedup": exact_dedup.ORACLE, "op3_mixing": mixing.ORACLE, "op7_url_filters": url_cascade.ORACLE}
