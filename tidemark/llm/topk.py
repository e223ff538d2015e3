"""Exact top-k inner products by a Voronoi join.

A bounded set of rows serves as pivots; every row belongs to the nearest. A group's summary is its size, the largest
distance from its pivot and the largest norm. First a query is solved in the groups with the highest bounds that hold
enough rows; its k-th score there is a bound for the second pass, which replicates the query to those groups only whose
q.x <= q.p + |q| * radius (or |q| * norm) could still reach it. Groups are cut in chunks, so one vector that holds a
third of all rows is many tasks. The summaries are as many as the pivots, whatever the data.

Components become floor(1024 * x) before all else, so scores are integers; sums beyond 64 bits wrap.
Defined results: vectors that are null, empty or hold a null or non-finite component take no part; vectors are only
compared with those of their length; of several rows with one query id the least vector asks, and none of them is found;
other repeated rows are each found; ties go to the smaller id. With fewer candidates than k, all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import Scratch

PIVOTS, K = 256, 10


def solve(left: pa.Table, right: pa.Table, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores in one cell for each query."""
    data, ids = vectors.matrix(left), left.column("vec_id").to_numpy()
    asked, names = vectors.matrix(right), right.column("query_id").to_numpy()
    exact = np.abs(data).max() * np.abs(asked).max() * data.shape[1] < 2**53  # then doubles hold every sum
    out = []
    for at in range(0, len(asked), 256):
        part = asked[at : at + 256]
        score = (part @ data.T).astype(np.int64) if exact else part.astype(np.int64) @ data.T.astype(np.int64)
        for q, own in enumerate(score):
            name = names[at + q]
            allowed = np.flatnonzero(ids != name)
            if len(allowed) > k:
                worst = np.partition(own[allowed], -k)[-k]
                allowed = allowed[own[allowed] >= worst]
            allowed = allowed[np.lexsort((ids[allowed], -own[allowed]))][:k]
            out.append((np.full(len(allowed), name), ids[allowed], own[allowed]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Summary:
    """Pivots with their groups' sizes, radii and norms, by length of vector."""

    def __init__(self, pivots: dict[int, np.ndarray], groups: list[tuple[int, int, int, float, float]]):
        self.pivots = pivots
        self.count = {d: np.zeros(len(p), np.int64) for d, p in pivots.items()}
        self.radius = {d: np.zeros(len(p)) for d, p in pivots.items()}
        self.norm = {d: np.zeros(len(p)) for d, p in pivots.items()}
        for dim, pivot, n, radius, norm in groups:
            self.count[dim][pivot], self.radius[dim][pivot], self.norm[dim][pivot] = n, radius, norm

    def bounds(self, asked: np.ndarray) -> np.ndarray:
        """Upper bound of a query's score in each group, with room for rounding."""
        dim = asked.shape[1]
        size = np.sqrt((asked**2).sum(1))[:, None]
        bound = np.minimum(asked @ self.pivots[dim].T + size * self.radius[dim][None, :], size * self.norm[dim][None, :])
        bound = bound + 1 + 1e-9 * (np.abs(bound) + size * self.norm[dim][None, :])
        bound[:, self.count[dim] == 0] = -np.inf
        return bound

    def first(self, asked: np.ndarray, k: int) -> np.ndarray:
        """Groups to look at first: the highest bounds that together hold more than k rows."""
        bound = self.bounds(asked)
        order = np.argsort(-bound, axis=1, kind="stable")
        held = np.cumsum(self.count[asked.shape[1]][order], axis=1)
        take = (held - self.count[asked.shape[1]][order]) <= k
        out = np.zeros(bound.shape, bool)
        np.put_along_axis(out, order, take, 1)
        return out & (bound > -np.inf)


def top(df: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score (integer inner product) of the k highest scores of each query."""
    scratch = Scratch(df.sparkSession)
    rows = vectors.usable(df.where(F.col("vec_id").isNotNull()))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * 1024).cast("double")))
    total = df.count()
    blocks = max(1, -(-total // (vectors.EVERY * vectors.QUERY_BLOCK)))
    chosen = rows.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(PIVOTS).collect()
    pivots: dict[int, list] = {}
    for r in chosen:
        pivots.setdefault(r["dim"], []).append(list(r["v"]))
    fixed = {d: np.unique(np.array(p), axis=0) for d, p in pivots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = batch.column("dim").to_numpy()
            pivot, radius, norm = np.full(len(dims), -1), np.full(len(dims), np.inf), np.full(len(dims), np.inf)
            for dim in np.unique(dims):
                if (own := fixed.get(int(dim))) is not None:
                    at = np.flatnonzero(dims == dim)
                    x = vectors.matrix(table.take(at))
                    square = (x**2).sum(1)
                    far = square[:, None] - 2 * x @ own.T + (own**2).sum(1)[None, :]
                    pivot[at] = far.argmin(1)
                    radius[at], norm[at] = np.sqrt(((x - own[pivot[at]]) ** 2).sum(1)), np.sqrt(square)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("dim"), pa.array(pivot.astype(np.int32)), pa.array(radius), pa.array(norm)], ["vec_id", "v", "dim", "pivot", "radius", "norm"])

    placed = scratch.table(rows.select("vec_id", "v", "dim").mapInArrow(place, "vec_id long, v array<double>, dim int, pivot int, radius double, norm double"))
    groups = placed.where("pivot >= 0").groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.max("radius").alias("r"), F.max("norm").alias("m"))
    known = [(r.dim, r.pivot, r.n, r.r, r.m) for r in groups.collect()]  # at most PIVOTS rows
    summary = Summary(fixed, known)
    sizes = {(d, p): max(1, -(-n // vectors.CHUNK)) for d, p, n, _, _ in known}
    rest = max(1, -(-total // vectors.CHUNK))  # chunks for lengths that no pivot has
    parts = F.lit(rest)
    if sizes:
        parts = F.coalesce(F.element_at(F.create_map(*[x for (d, p), n in sizes.items() for x in (F.lit(f"{d}:{p}"), F.lit(n))]), F.concat_ws(":", "dim", "pivot")), F.lit(rest))
    data = placed.select("vec_id", "v", "dim", "pivot").withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), parts).cast("int"))

    asked = scratch.table(vectors.queries(rows))

    def route(second: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table, dims = pa.Table.from_batches([batch]), batch.column("dim").to_numpy()
                take, pivot = [], []
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    if int(dim) not in summary.pivots:
                        if not second:
                            take.append(at)
                            pivot.append(np.full(len(at), -1))
                        continue
                    x = vectors.matrix(table.take(at))
                    go = summary.first(x, k)
                    if second:
                        least = batch.column("least").to_numpy(zero_copy_only=False)[at]
                        go = (summary.bounds(x) >= np.where(np.isnan(least), -np.inf, least)[:, None]) & ~go & (summary.count[int(dim)] > 0)[None, :]
                    q, p = np.nonzero(go)
                    take.append(at[q])
                    pivot.append(p)
                index = pa.array(np.concatenate(take) if take else np.zeros(0, np.int64))
                got = batch.select(["query_id", "v", "dim"]).take(index)
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(np.concatenate(pivot).astype(np.int32) if pivot else np.zeros(0, np.int32))], ["query_id", "v", "dim", "pivot"])

        return run

    def cells(queries: DataFrame, second: bool) -> DataFrame:
        sent = queries.mapInArrow(route(second), "query_id long, v array<double>, dim int, pivot int")
        # data of groups to which no query goes needn't move; groups are at most PIVOTS, and one for each length without a pivot
        sent = scratch.table(sent)
        groups = sent.select("dim", "pivot").distinct()
        mine = data.join(F.broadcast(groups), ["dim", "pivot"], "left_semi")
        sent = sent.withColumn("chunk", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)))
        return vectors.grid(mine, sent, blocks, ["dim", "pivot", "chunk"], lambda a, b: solve(a, b, k), "long")

    one = scratch.table(vectors.best(cells(asked, False), k, largest=True))
    least = one.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("least"))
    two = cells(asked.join(least, "query_id", "left"), True)
    return vectors.best(one.select("query_id", "vec_id", "score").union(two), k, largest=True)


#: The same for DuckDB.
SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, min(v) AS v FROM e WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (
  SELECT query_id, vec_id, list_inner_product(q.v::DOUBLE[], e.v::DOUBLE[])::BIGINT AS score
  FROM q JOIN e ON e.vec_id <> q.query_id AND len(e.v) = len(q.v))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
