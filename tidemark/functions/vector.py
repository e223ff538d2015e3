"""Distances between array columns, as expressions, in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _same_length(a: Column, b: Column, value: Column) -> Column:
    """Null if either is null; lengths that differ fail the query (zip_with would pad)."""
    return F.when(a.isNull() | b.isNull(), None).when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors have different lengths"))).otherwise(value)


def inner_product(a: Column, b: Column) -> Column:
    return _same_length(a, b, _dot(a, b))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if either vector is null or has norm zero."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return _same_length(a, b, F.when(norms != 0, 1 - _dot(a, b) / norms))


def l2_squared(a: Column, b: Column) -> Column:
    steps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return _same_length(a, b, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x))


#: ``_distance`` of a search by metric: squared l2, 1 - cosine, 1 - dot. Smaller is nearer.
DISTANCES = {"l2": l2_squared, "cosine": cosine_distance, "dot": lambda a, b: 1 - inner_product(a, b)}

COSINE_SQL = """CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL
 WHEN size({a}) <> size({b}) THEN CAST(raise_error('vectors have different lengths') AS DOUBLE)
 ELSE 1 - aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)
 / nullif(sqrt(aggregate({a}, CAST(0 AS DOUBLE), (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * sqrt(aggregate({b}, CAST(0 AS DOUBLE), (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 0) END"""


def register_cosine(spark) -> None:
    """``cosine_distance(a, b)`` in SQL, as a function that the optimizer inlines."""
    body = COSINE_SQL.format(a="a", b="b")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")


def cosine_function():
    """The same as a function on Arrow batches, which may stand in any clause and evaluates its arguments once."""
    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return None
            if len(x) != len(y):
                raise ValueError("vectors have different lengths")
            x, y = np.asarray(x, float), np.asarray(y, float)
            norm = np.sqrt(x @ x) * np.sqrt(y @ y)
            return 1 - x @ y / norm if norm else None

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return cosine
