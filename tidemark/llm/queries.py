"""The queries opN_<name>: each operator with production parameters over its whole table; and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, lm, minhash, mixing, pii, quality, secrets, suffix, topk
from .common import load


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(load(spark, sf_dir, "documents"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(load(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents")).drop("tk", "group")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(load(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(load(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top(load(spark, sf_dir, "embeddings"))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(load(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.in_order(mixing.plan(load(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_pii": op1_pii, "op2_lm": op2_lm, "op3_near_duplicates": op3_near_duplicates, "op4_ann": op4_ann, "op5_secrets": op5_secrets, "op6_bpe": op6_bpe, "op7_topk": op7_topk, "op8_suffix": op8_suffix, "op9_quality": op9_quality, "op10_mixing": op10_mixing}

ORACLES: dict[str, str] = {"op7_topk": topk.SQL, "op10_mixing": mixing.SQL}
