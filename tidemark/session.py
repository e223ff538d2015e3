"""A session with the settings that the engine's semantics rely on."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}

#: Bytes of a record batch that goes to a Python worker, unless one row is larger.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bounded(spark: SparkSession) -> None:
    """From now on this session's record batches are bounded by bytes, so that long texts don't fill a worker's memory."""
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH)) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def session(name: str = "tidemark", **more: str) -> SparkSession:
    """Get or create one; ``more`` are settings with underscores for dots."""
    made = SparkSession.builder.appName(name).config(map=SETTINGS)
    for key, value in more.items():
        made = made.config(key.replace("_", "."), value)
    return made.getOrCreate()
