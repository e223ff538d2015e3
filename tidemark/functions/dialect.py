"""Names that other SQL dialects use, as Spark expressions and as SQL functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: SQL functions by signature; the optimizer inlines them.
SQL = {
    "date_bin(width INTERVAL DAY TO SECOND, t TIMESTAMP) RETURNS TIMESTAMP": "timestamp_micros(CAST(floor(unix_micros(t) / (extract(SECOND FROM width) * 1000000 + extract(MINUTE FROM width) * 60000000 + extract(HOUR FROM width) * 3600000000 + extract(DAY FROM width) * 86400000000)) * (extract(SECOND FROM width) * 1000000 + extract(MINUTE FROM width) * 60000000 + extract(HOUR FROM width) * 3600000000 + extract(DAY FROM width) * 86400000000) AS BIGINT))",
    "starts_with(s STRING, p STRING) RETURNS BOOLEAN": "startswith(s, p)",
    "ends_with(s STRING, p STRING) RETURNS BOOLEAN": "endswith(s, p)",
    "strpos(s STRING, p STRING) RETURNS INT": "instr(s, p)",
    "to_hex(n BIGINT) RETURNS STRING": "lower(hex(n))",
    "iszero(x DOUBLE) RETURNS BOOLEAN": "x = 0",
    "to_unixtime(t TIMESTAMP) RETURNS BIGINT": "unix_timestamp(t)",
    "to_timestamp_seconds(n BIGINT) RETURNS TIMESTAMP": "timestamp_seconds(n)",
    "to_timestamp_millis(n BIGINT) RETURNS TIMESTAMP": "timestamp_millis(n)",
    "to_timestamp_micros(n BIGINT) RETURNS TIMESTAMP": "timestamp_micros(n)",
    "sha224(s STRING) RETURNS STRING": "sha2(s, 224)",
    "sha256(s STRING) RETURNS STRING": "sha2(s, 256)",
    "sha384(s STRING) RETURNS STRING": "sha2(s, 384)",
    "sha512(s STRING) RETURNS STRING": "sha2(s, 512)",
    "arrow_typeof(x STRING) RETURNS STRING": "typeof(x)",
    "array_has(a ARRAY<STRING>, x STRING) RETURNS BOOLEAN": "array_contains(a, x)",
    "array_has_any(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS BOOLEAN": "arrays_overlap(a, b)",
    "array_has_all(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS BOOLEAN": "size(array_except(b, a)) = 0",
    "regexp_match(s STRING, p STRING) RETURNS ARRAY<STRING>": "regexp_extract_all(s, p, 0)",
    "today() RETURNS DATE": "current_date()",
}
#: Aggregates and functions whose name alone differs, for rewriting statements.
RENAMED = {
    "var": "var_samp", "covar": "covar_samp", "approx_distinct": "approx_count_distinct", "approx_percentile_cont": "approx_percentile", "make_array": "array", "array_concat": "concat", "array_length": "size", "datetrunc": "date_trunc", "row": "struct",
}


QUOTED = re.compile(r"('(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`)")
CALLED = re.compile(rf"\b({'|'.join(RENAMED)})(?=\s*\()", re.I)


def renamed(text: str) -> str:
    """The statement with Spark's names for functions that others call differently; what is quoted stays."""
    parts = QUOTED.split(text)
    return "".join(p if i % 2 else CALLED.sub(lambda m: RENAMED[m[1].lower()], p) for i, p in enumerate(parts))


def register(spark: SparkSession) -> None:
    for signature, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def date_bin(seconds: float, t: Column) -> Column:
    """The start of the bin of so many seconds since 1970 that a timestamp falls in."""
    width = int(seconds * 1_000_000)
    return F.timestamp_micros((F.floor(F.unix_micros(t) / F.lit(width)) * width).cast("long"))


def integer_divide(a: Column, b: Column) -> Column:
    """Division that cuts off towards zero, as integers have in other dialects; Spark's own / gives a fraction."""
    return F.call_function("div", a, b)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two integers by Euclid's steps, at most 93 of which 64 bits need."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, lambda s, _: F.when(s.y == 0, s).otherwise(F.struct(s.y.alias("x"), (s.x % F.when(s.y == 0, F.lit(1)).otherwise(s.y)).alias("y"))))
    return end.x


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple; the division comes first and is one of integers, so only a result beyond 64 bits overflows."""
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(integer_divide(a.cast("long"), gcd(a, b)) * b.cast("long")))
