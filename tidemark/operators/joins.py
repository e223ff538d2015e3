"""The nearest row of the same class for each of many queries: all pairs, block by block, in bounded memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and queries that are dealt out to a block together, and numbers in a matrix of distances.
ROWS_A_BLOCK, QUERIES_A_BLOCK, MATRIX = 50_000, 20_000, 1 << 22


def _read(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, and which of them are null or hold a null."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    null = np.asarray(lists.is_null())
    flat = lists.drop_null().flatten()
    x = np.full((len(null), len(flat) // max(1, (~null).sum())), np.nan)
    if x.size:
        x[~null] = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, x.shape[1])
    if flat.null_count:
        null[np.flatnonzero(~null)[np.asarray(flat.is_null()).reshape(-1, x.shape[1]).any(1)]] = True
    return x, null


def _exact(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances, added up from the first component on as the expression of ``functions.vector`` does."""
    return np.cumsum((rows - q) ** 2, axis=1)[:, -1] if 0 < rows.shape[1] == len(q) else np.full(len(rows), np.nan)


def nearest_of(queries: pa.Table, rows: pa.Table) -> pa.Table:
    """query_id, whether the distance is null, d and vec_id of the nearest other row, for each query that has one. The product
    of matrices only leaves out rows that its rounding can't make nearest; those that are left are measured exactly."""
    ids, asked = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    x, x_null = (a[order] for a in _read(rows["embedding"]))
    q, q_null = _read(queries["q"])
    fine = np.flatnonzero(~x_null & np.isfinite(x).all(1))
    square = (x[fine] ** 2).sum(1)
    out = []
    step = max(1, MATRIX // max(1, len(fine)))
    for at in range(0, len(asked), step):
        part = q[at : at + step]
        whole = np.isfinite(part).all(1) & ~q_null[at : at + step]
        norm = (np.where(whole[:, None], part, 0) ** 2).sum(1)
        far = norm[:, None] + square - 2 * (np.where(whole[:, None], part, 0) @ x[fine].T) if len(fine) and x.shape[1] == q.shape[1] else None
        for i, own in enumerate(asked[at : at + step]):
            some = np.empty(0, int)
            if far is not None and whole[i]:
                line = far[i]
                line[ids[fine] == own] = np.inf
                least = line.min()
                # the rounding of both ways to add up is far below this part of the squares
                some = fine[line <= least + 1e-11 * (norm[i] + square.max())] if np.isfinite(least) else some
            if not len(some):  # vectors that aren't comparable come last, null after the others
                some = np.flatnonzero(ids != own)
                if not len(some):
                    continue
            null = x_null[some] | q_null[at + i]
            with np.errstate(invalid="ignore"):
                d = _exact(x[some], part[i])
            best = np.lexsort((ids[some], d, null))[0]
            out.append((own, bool(null[best]), None if null[best] else float(d[best]), ids[some][best]))
    return pa.table({k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate((("query_id", pa.int64()), ("none", pa.bool_()), ("d", pa.float64()), ("vec_id", pa.int64())))})


def nearest_join(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """asked: query_id, q, label; rows: vec_id, embedding, label. For each query, the nearest row of its label but its own.

    Each block of queries meets each block of rows once, so work is that of all pairs, and is dealt out whatever labels there are."""
    across, down = max(1, -(-rows.count() // ROWS_A_BLOCK)), max(1, -(-asked.count() // QUERIES_A_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = asked.where("label is not null").select("query_id", "q", "label", part("query_id", down).alias("down"), every(across).alias("across"))
    right = rows.where("label is not null").select("vec_id", "embedding", "label", part("vec_id", across).alias("across"), every(down).alias("down"))
    keys = ("label", "down", "across")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest_of, "query_id long, none boolean, d double, vec_id long")
    return near.groupBy("query_id").agg(F.min(F.struct("none", "d", "vec_id")).alias("near")).select("query_id", "near.vec_id", "near.d")
