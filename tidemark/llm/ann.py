"""Approximate nearest neighbours by collision counting.

Each chunk of data keeps one sorted array for each of a number of random projections. A query opens a window around its
own projection in each array; virtual rehashing widens all windows together, radius by radius, and only what a window
gains is read. Vectors that are in the windows of enough projections are verified: their exact distance is computed.
A query stops in a chunk when its k-th verified distance is within the radius, or when the windows hold all.
Projections are made of vectors over their largest component, so that none overflows; the distances are those of the vectors
as they are, infinite where the sum of squares is beyond a double. With windows of W radii, a vector within the radius is in one with probability 0.83, and 64 projections with a threshold
of 0.62 miss it in about one of 20,000 cases; nothing caps the number of candidates.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part; vectors are only
compared with those of their length; of several rows with one query id the least vector asks, and none of them is found;
other repeated rows are each found. With fewer candidates than k, all are returned. Null ids take no part in results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import ragged

PROJECTIONS, THRESHOLD, WIDTH, WIDEN, K = 64, 0.62, 2.72, 1.5, 10


def search(data: np.ndarray, ids: np.ndarray, asked: np.ndarray, names: np.ndarray, k: int = K) -> tuple[list, list, list]:
    """Query ids, ids and distances of up to k near rows of one chunk for each query."""
    n, dim = data.shape
    axes = np.random.default_rng(4).standard_normal((dim, PROJECTIONS))
    unit = max(np.abs(data).max(), np.abs(asked).max())
    place, centre = (data / unit) @ axes, (asked / unit) @ axes
    order = np.argsort(place, axis=0, kind="stable").T  # row j: the rows of data along projection j
    low = min(place.min(), centre.min()) - 1
    scale = max(place.max(), centre.max()) + 1 - low  # puts all arrays end to end in one
    base = np.arange(PROJECTIONS) * (4 * scale)
    line = (np.take_along_axis(place.T, order, 1) - low + base[:, None]).ravel()
    first = np.arange(PROJECTIONS) * n
    radius0 = max(float(place.std()) / 8, 1e-12)
    need = int(np.ceil(THRESHOLD * PROJECTIONS))
    flat = order.ravel()
    out_q, out_x, out_s = [], [], []
    for q in range(len(asked)):
        at = centre[q] - low + base
        left = right = np.searchsorted(line, at)
        left = right = np.clip(left, first, first + n)
        counts, seen, dist = np.zeros(n, np.int64), np.zeros(n, bool), np.full(n, np.inf)
        own = ids == names[q]
        k_own = min(k, n - int(own.sum()))
        radius = radius0
        while k_own:
            half = min(radius * WIDTH / 2, scale)
            new_left = np.clip(np.searchsorted(line, at - half, side="left"), first, left)
            new_right = np.clip(np.searchsorted(line, at + half, side="right"), right, first + n)
            gained = flat[np.concatenate([ragged(new_left, left - new_left), ragged(right, new_right - right)])]
            left, right = new_left, new_right
            counts += np.bincount(gained, minlength=n)
            fresh = np.flatnonzero((counts >= need) & ~seen & ~own)
            if len(fresh):
                seen[fresh] = True
                with np.errstate(over="ignore"):
                    dist[fresh] = np.sqrt(((data[fresh] - asked[q]) ** 2).sum(1))
            if (right - left == n).all():  # each window holds all rows
                break
            if seen.sum() >= k_own and np.partition(dist, k_own - 1)[k_own - 1] / unit <= radius:
                break
            radius *= WIDEN
        near = np.flatnonzero(seen)
        near = near[np.lexsort((ids[near], dist[near]))][:k]
        out_q += [names[q]] * len(near)
        out_x += ids[near].tolist()
        out_s += dist[near].tolist()
    return out_q, out_x, out_s


def nearest(df: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest rows found for each query."""
    rows = vectors.usable(df.where(F.col("vec_id").isNotNull()), zero=False)
    total = df.count()
    chunks, blocks = max(1, -(-total // vectors.CHUNK)), max(1, -(-total // (vectors.EVERY * vectors.QUERY_BLOCK)))
    data = rows.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(chunks)))
    asked = vectors.queries(rows).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    def solve(left, right):
        return search(vectors.matrix(left), left.column("vec_id").to_numpy(), vectors.matrix(right), right.column("query_id").to_numpy(), k)

    return vectors.best(vectors.grid(data, asked, blocks, ["dim", "chunk"], solve, "double"), k, largest=False)
