"""What text and vector indexes hold: postings sorted by term, and vectors sorted by the cell of their nearest centre.

Both are Parquet beside a generation, with the generation's row identity, so that a search reads the row groups of its
terms or cells only. They say nothing of newer rows; a search matches identity and sequence with the current rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.text import words
from ..schema import SEQ

TERM, TF, LENGTH, CELL = "_tm_term", "_tm_tf", "_tm_length", "_tm_cell"
#: The term under which every row is filed with its length, text or none.
ALL = ""
#: Bounds of the sample that centres are fitted on, and of their number; every row is indexed.
SAMPLE_PER_CELL, SAMPLE_BYTES, MOST_CELLS, ROUNDS = 64, 64 << 20, 1024, 12


def _ranged(df: DataFrame, first: str, ident: list[str]) -> DataFrame:
    """By a column in order, its frequent values over several partitions."""
    return df.withColumn("_tm_salt", F.xxhash64(*ident)).repartitionByRange(first, "_tm_salt").sortWithinPartitions(first).drop("_tm_salt")


def counted(df: DataFrame, ident: list[str], column: str) -> DataFrame:
    """Of each row, its terms with tf, and its number of words. A text's words are counted where it is, by sorting them."""
    each = df.select(*[F.col(f"`{c}`") for c in ident], F.array_sort(words(F.col(f"`{column}`"))).alias("_tm_w")).withColumn(LENGTH, F.size("_tm_w"))
    w, at = F.col("_tm_w"), F.col("_tm_at")
    heads = F.filter(F.sequence(F.lit(1), F.col(LENGTH)), lambda i: (i == 1) | (F.element_at(w, i) != F.element_at(w, F.greatest(i - 1, F.lit(1)))))
    each = each.withColumn("_tm_at", F.when(F.col(LENGTH) > 0, heads).otherwise(F.array().cast("array<int>")))
    terms = F.transform(at, lambda i, k: F.struct(F.element_at(w, i).alias(TERM), (F.coalesce(F.get(at, k + 1), F.col(LENGTH) + 1) - i).alias(TF)))
    filed = F.concat(F.array(F.struct(F.lit(ALL).alias(TERM), F.col(LENGTH).alias(TF))), terms)
    return each.select(*[F.col(f"`{c}`") for c in ident], LENGTH, filed.alias("_tm_filed"))


def filed(df: DataFrame, ident: list[str]) -> DataFrame:
    """Term, identity, tf and the text's number of words, by term. What was counted is looked at up to three times, twice for the ranges."""
    return _ranged(df.select(*[F.col(f"`{c}`") for c in ident], LENGTH, F.inline("_tm_filed")), TERM, [f"`{c}`" for c in ident])


def postings(df: DataFrame, ident: list[str], column: str) -> DataFrame:
    return filed(counted(df, ident, column), ident)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less the squares of x, which are the same for all centres."""
    return (centres**2).sum(1) - 2 * x @ centres.T


def fit_centres(df: DataFrame, column: str, metric: str, cells: int | None, rows: int) -> list[list[float]]:
    """Centres by k-means over a bounded sample, the rows of least hash."""
    v = F.col(f"`{column}`")
    width = df.select(F.max(F.size(v))).first()[0] or 1
    wanted = min(cells or max(1, round(rows**0.5)), MOST_CELLS)
    most = max(wanted, min(wanted * SAMPLE_PER_CELL, SAMPLE_BYTES // (8 * width)))
    taken = df.where(v.isNotNull()).select(v.cast("array<double>").alias("v")).orderBy(F.xxhash64("v"), "v").limit(most).collect()
    x = np.array([r.v for r in taken if all(c is not None for c in r.v)], float).reshape(-1, width)
    x = x[np.isfinite(x).all(1)]
    x = _unit(x) if metric == "cosine" else x
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(7).permutation(len(x))[:wanted]]
    for _ in range(ROUNDS if len(centres) else 0):
        own = _near(x, centres).argmin(1)
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres.tolist()


def cells(df: DataFrame, ident: list[str], column: str, metric: str, centres: list[list[float]]) -> DataFrame:
    """Cell, identity and vector of every row with a vector; those that no centre is comparable with are in cell -1."""
    fixed = np.array(centres, float)
    v = F.col(f"`{column}`")
    rows = df.where(v.isNotNull()).select(*[F.col(f"`{c}`") for c in ident], v)
    schema = T.StructType([*rows.schema.fields, T.StructField(CELL, T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.full(batch.num_rows, -1, np.int32)
            if len(fixed):
                got = batch.column(batch.schema.get_field_index(column))
                flat = got.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                x = flat.reshape(batch.num_rows, -1) if len(flat) == batch.num_rows * fixed.shape[1] else np.full((batch.num_rows, fixed.shape[1]), np.nan)
                fine = np.isfinite(x).all(1)
                part = _unit(x[fine]) if metric == "cosine" else x[fine]
                own[fine] = _near(part, fixed).argmin(1) if len(part) else own[fine]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*batch.schema.names, CELL])

    return _ranged(rows.mapInArrow(assign, schema), CELL, [f"`{c}`" for c in ident])


def probed(centres: list[list[float]], vector: list[float], metric: str, nprobes: int) -> list[int]:
    """The cells to read, nearest centre first, and always the one of vectors that aren't comparable."""
    fixed, q = np.array(centres, float), np.array([vector], float)
    if not len(fixed):
        return [-1]
    far = -(q @ fixed.T)[0] if metric == "dot" else _near(_unit(q) if metric == "cosine" else q, fixed)[0]
    return [-1, *np.argsort(far, kind="stable")[: max(1, nprobes)].tolist()]


def lengths(stored: DataFrame) -> DataFrame:
    return stored.where(F.col(TERM) == ALL)


def hits(stored: DataFrame, terms: list[str], ident: list[str]) -> DataFrame:
    return stored.where(F.col(TERM).isin(terms)).select(TERM, TF, LENGTH, *[F.col(f"`{c}`") for c in ident], SEQ)
