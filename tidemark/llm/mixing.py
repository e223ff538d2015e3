"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Targets: sources weigh in turn, share a multiple of all words, and stop at a cap; the excess is shared again by weight.
With the cap reached in order of cap over weight, the common level is the largest of (total - caps before) / weights
from here on, so one window over the sources settles it.

Curriculum: a source's weight at time t of the training, 0 to 1, is target * (1 + slope * (2 t - 1)), and its integral
target * (t + slope * (t^2 - t)) says how many of its words have been shown by then. Documents stand in an order that a
hash of the id gives; a document's offset in its source is inverted to the time at which its turn comes. A source whose
target exceeds its size is gone through again. Documents are range-sorted by that time.

Defined results: a null text has size 0; null sources form one source, the last; documents without words take none and
have the position where their turn would come; repeated rows each have their own turn, in an order that doesn't matter.
Offsets are sums over (source, hash prefix) groups of bounded size, so a source that holds most rows is not one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS, SHARE, CAP, SLOPES = (3, 1, 2), 1.5, 2.0, (-0.5, 0.0, 0.5)
#: Rows that a group of one hash prefix holds on average, over all sources.
GROUP = 2048


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """From (source, skey, source_size): adds target and slope. One row per source; the window is as large as that."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), (F.col("turn") % len(values) + 1).cast("int"))
    out = sizes.withColumn("turn", turn).withColumn("weight", pick(weights)).withColumn("slope", pick(SLOPES)).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(float(share))
    out = out.withColumn("level", (total - before) / left)
    level = F.max("level").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.withColumn("target", F.least("cap", level * F.col("weight"))).select("skey", "source_size", "target", "slope")


def time_of(offset, target, slope):
    """When a source has shown so many words: the curriculum's integral, inverted."""
    y, rest = offset / target, 1 - slope
    return 2 * y / (rest + F.sqrt(rest * rest + 4 * slope * y))


def plan(df: DataFrame) -> DataFrame:
    """Per row doc_id, size, source_size, target, taken, position and again (the second turn's position; or null)."""
    return _plan(df, ("doc_id",)).withColumnRenamed("_0", "doc_id")


def _plan(df: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The same, with the carried columns as _0, _1, ... in place of doc_id."""
    held = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)]
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    digits = max(1, math.ceil(math.log(max(1, df.count() / GROUP), 16)))
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = df.select(*held, "doc_id", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("skey"), size.alias("size"), hashed.alias("h"))
    rows = rows.withColumn("prefix", F.substring("h", 1, digits))
    narrow = rows.select("source", "skey", "prefix", "size")
    groups = narrow.groupBy("source", "skey", "prefix").agg(F.sum("size").alias("part"))
    goal = targets(groups.groupBy("source", "skey").agg(F.sum("part").alias("source_size")))
    earlier = Window.partitionBy("skey").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("base", F.coalesce(F.sum("part").over(earlier), F.lit(0))).join(goal, "skey").select("skey", "prefix", "base", "source_size", "target", "slope")
    within = Window.partitionBy("skey", "prefix").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(groups, ["skey", "prefix"])
    first = F.col("base") + F.col("inner")
    second = first + F.col("source_size")
    upto = F.round("target").cast("long")
    share = lambda at: F.greatest(F.lit(0), F.least("size", upto - at))
    when = lambda at: F.when((F.col("target") > 0) & (at < upto), time_of(at, F.col("target"), F.col("slope")))
    return rows.select(*[f"_{i}" for i in range(len(carry))], "size", "source_size", "target", (share(first) + share(second)).alias("taken"), when(first).alias("position"), when(second).alias("again"))


def in_order(df: DataFrame) -> DataFrame:
    """Range-sorted by position; what has none comes last."""
    return df.orderBy(F.col("position").asc_nulls_last(), df.columns[0])


def mixed(df: DataFrame) -> DataFrame:
    """The documents in training order, with the columns of df: each once for every turn of which the mix takes a word."""
    names = df.columns
    rows, held = _plan(df, tuple(names)), [f"_{i}" for i in range(len(names))]
    turns = F.filter(F.array("position", "again"), lambda t: t.isNotNull())
    reached = F.col("size") > 0
    out = rows.where(reached).select(*held, F.explode(turns).alias("position"))
    return in_order(out).select(*[F.col(h).alias(c) for h, c in zip(held, names, strict=True)])


#: The same for DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight,
         CASE turn % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS slope, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, ((sum(source_size::DOUBLE) OVER ()) * 1.5::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, slope, least(cap, max(level) OVER () * weight) AS target FROM l),
o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, round(t.target)::BIGINT AS upto,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, a + source_size AS b FROM o)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, upto - a)) + greatest(0, least(size, upto - b)))::BIGINT AS taken,
       CASE WHEN target > 0 AND a < upto THEN 2 * (a / target) / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * (a / target))) END AS position,
       CASE WHEN target > 0 AND b < upto THEN 2 * (b / target) / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * (b / target))) END AS again
FROM p
"""
