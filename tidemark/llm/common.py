"""What the operators of this subpackage share: shared-folder checkpoints and block-wise text handling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once, unless one document alone is longer.
BLOCK_BYTES = 2 << 20
#: Bytes of a record batch that goes to a Python worker, unless one row is larger.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded(spark: SparkSession) -> None:
    """From now on this session's record batches are bounded by bytes, so that long texts don't fill a worker's memory."""
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH)) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Tables written to the shared folder to cut lineage; lost executors don't lose them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []
        bounded(spark)

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/tidemark-{uuid.uuid4().hex}"
        schema = df.schema
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")  # the shuffle files go as soon as the table is written
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        made = self.spark.read.schema(schema).parquet(path)
        self.made.append((made, path))
        return made

    def clear(self, *keep: DataFrame) -> None:
        """Remove the tables made so far but those to keep. What was derived from the others must have been written by now."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        gone = [x for x in self.made if not any(x[0] is df for df in keep)]
        self.made = [x for x in self.made if any(x[0] is df for df in keep)]
        for _, at in gone:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)


def words_col(text):
    """Array column of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null: empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts as large strings, null: empty. Copied, since string kernels misread the offsets of a slice that was cast."""
    got = batch.column(batch.schema.get_field_index(column))
    return pc.fill_null(got.cast(pa.large_string()), "").take(pa.array(np.arange(len(got))))


def tokens(text: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, flattened, and each text's number of words. A-Z are lower-cased."""
    if lower:
        text = pc.ascii_lower(text)
    # \x1c-\x1f and the like are no separators here, so splitting goes by pattern of single characters, not by isspace
    for c in "\t\n\x0b\x0c\r":
        text = pc.replace_substring(text, pattern=c, replacement=" ")
    split = pc.split_pattern(text, pattern=" ")
    flat, parent = pc.list_flatten(split), pc.list_parent_indices(split)
    full = pc.not_equal(pc.binary_length(flat), 0)
    flat, parent = flat.filter(full), parent.filter(full)
    return flat, np.bincount(parent.to_numpy(zero_copy_only=False), minlength=len(text)).astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (Stafford's variant 13)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; equal words are hashed once."""
    import xxhash

    coded = flat.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, run after run."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
