"""What the searches over vectors share: usable rows, a grid of data chunks and query blocks, and merged ranks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of data in a chunk and of queries in a block, on average; a grid cell holds one of each in memory.
CHUNK, QUERY_BLOCK, EVERY = 4096, 4096, 100
FOUND = "query_id long, vec_id long, score {}"


def usable(df: DataFrame, zero: bool = True) -> DataFrame:
    """vec_id, v (array<double>) and dim of the rows that take part: no null or non-finite component, and zero only if asked."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & fine & (F.size("v") > 0))
    rows = rows if zero else rows.where(F.exists("v", lambda x: x != 0))
    return rows.withColumn("dim", F.size("v"))


def queries(rows: DataFrame) -> DataFrame:
    """The stated query set, a row per id: of rows with the same id the least vector asks."""
    return rows.where(F.col("vec_id") % EVERY == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def matrix(table: pa.Table, name: str = "v") -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in table.column(name).chunks]) if table.num_rows else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1))


def grid(data: DataFrame, asked: DataFrame, blocks: int, keys: list[str], solve: Callable[[pa.Table, pa.Table], tuple], kind: str) -> DataFrame:
    """query_id, vec_id, score from each cell's data and queries, which are brought together by keys and query block.

    data goes to every block, asked to the block its id hashes to; solve gives query ids, vec ids and scores.
    """
    out = FOUND.format(kind)
    types = {"double": pa.float64(), "long": pa.int64()}

    def cell(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            q, x, s = solve(left, right)
        else:
            q = x = s = []
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(x, pa.int64()), "score": pa.array(s, types[kind])})

    left = data.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    return left.groupBy(*keys, "qb").cogroup(right.groupBy(*keys, "qb")).applyInArrow(cell, out)


def best(found: DataFrame, k: int, largest: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query; ties go to the smaller id."""
    order = [F.col("score").desc() if largest else F.col("score").asc(), F.col("vec_id").asc()]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
