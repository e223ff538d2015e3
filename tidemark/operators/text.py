"""Full-text search: lower-cased words, no stemming, any term matches, ranked by BM25."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def words(text: Column) -> Column:
    """Array of a text's words: runs of letters, digits and _."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def terms_of(query: str) -> list[str]:
    return sorted(set(re.findall(r"\w+", query.lower())))


def bm25(found: DataFrame, every: DataFrame, ident: list[str]) -> DataFrame:
    """ident and ``_score`` of the rows that hold a term, from their postings and the length of every row."""
    known = every.agg(F.count("*").alias("n"), F.sum("_tm_length").alias("total")).first()
    counted = {r["_tm_term"]: r["count"] for r in found.groupBy("_tm_term").count().collect()}  # a row per asked term
    mean = max((known["total"] or 0) / max(known["n"], 1), 1e-9)
    weight = F.lit(0.0)
    for term, d in counted.items():
        weight = F.when(F.col("_tm_term") == term, F.lit(math.log(1 + (known["n"] - d + 0.5) / (d + 0.5)))).otherwise(weight)
    tf = F.col("_tm_tf").cast("double")
    score = weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_tm_length") / F.lit(mean)))
    return found.groupBy(*[f"`{c}`" for c in ident]).agg(F.sum(score).alias("_score"))
