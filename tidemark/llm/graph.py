"""Connected components by alternating large-star and small-star rounds, with DataFrame operations only; few edges are joined on
the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Up to so many edges, whatever the size of the data, go to the driver (1 MB of long ends): one job in place of some twenty.
FEW = 1 << 16


def joined(edges: pa.Table) -> pa.Table:
    """(node, label) of edges (u, v) without null ends, by union-find; the smallest node of each component is its root."""
    above: dict = {}

    def root(x):
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for u, v in zip(edges.column("u").to_pylist(), edges.column("v").to_pylist(), strict=True):
        low, high = sorted((root(u), root(v)))
        above[high] = low
    kind = edges.schema.field("u").type
    return pa.table({"node": pa.array(list(above), kind), "label": pa.array([root(x) for x in list(above)], kind)})


def components(edges: DataFrame, scratch: Scratch, few: int = FEW) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (u, v) reaches.

    Groups are only ever reduced to their minimum, with partial aggregation, and joined back; no neighbour list is
    gathered. Each round is written to the shared folder. Null ends are ignored. The edges are read more than once, so
    they should be a written table.
    """
    if edges.count() <= few:
        made = joined(edges.where("u <> v").select("u", "v").toArrow())
        return scratch.table(edges.sparkSession.createDataFrame(made))

    def spread(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs (u, v), and the least of each u and its v."""
        return pairs, scratch.table(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))

    now = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        pairs, least = spread(both)
        large = pairs.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = scratch.table(large.distinct())  # u > v throughout
        pairs, least = spread(large)
        small = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v")
        now = scratch.table(small.distinct())
        state = now.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38,0))"))).first()
        if state == before:
            break
        before = state
    ends = now.groupBy("u").agg(F.min("v").alias("label"))
    return scratch.table(ends.select(F.col("u").alias("node"), "label").union(ends.select(F.col("label").alias("node"), "label").distinct()))
