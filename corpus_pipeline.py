"""A corpus from raw documents to token ids: classify, deduplicate, redact, mix, encode.

Each stage works on all rows that the one before it kept, written as Parquet and read again. All but the last return the
columns of ``documents``. Quality and near-duplicates are decided on the stage's own input; secrets are replaced in the
text; mixing gives a row for each turn that a document takes, in training order; the last stage gives ids and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, minhash, mixing, quality, secrets
from tidemark.llm.common import Scratch, load
from tidemark.llm.queries import tokenizer_path


#: Shingles in both of all shingles in either, of 100, from which on two documents are near duplicates.
PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier keeps."""
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts at least 0.8 alike, with its smallest id; rows without words link with nothing and
    all stay."""
    names = docs.columns
    # numbered, so that no column of the documents can clash with those that are added here
    docs = docs.select([F.col(f"`{c}`").alias({"doc_id": "doc_id", "text": "text"}.get(c, f"_c{i}")) for i, c in enumerate(names)])
    found = minhash.near_duplicates(docs, PERCENT)
    one = found.where("kept and group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "tk")).alias("row")).select("row.doc_id", "row.tk")
    empty = found.where("group is null").select("doc_id", "tk").distinct()
    kept = Scratch(spark).table(one.union(empty).toDF("_id", "_tk"))
    wordless = ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    same = F.expr("doc_id <=> _id and _key = _tk")
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    rows = keyed.join(kept, same, "left_semi")
    # only rows that are repeated as a whole have to meet again; most tables have none
    repeated = keyed.where(~wordless).groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_tk")).agg(F.count("*").alias("n"))
    repeated = Scratch(spark).table(repeated.where("n > 1").drop("n"))
    if not repeated.isEmpty():
        again = rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_key"])
        rows = rows.join(repeated, same, "left_anti").unionByName(again)
    return rows.drop("_key").toDF(*names)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows; secrets in the text give way to their kind."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each turn of a document in the mix, range-sorted by position."""
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and the digests of the ids and of what they decode to."""
    return bpe.encode(docs, tokenizer_path(), keep=("doc_id", "source"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("secrets", secret_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of a folder."""
    docs, written = load(spark, sf_dir, "documents"), Scratch(spark)
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = written.table(docs)
            written.clear(docs)
    return docs
