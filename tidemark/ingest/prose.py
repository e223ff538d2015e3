"""Whether a column is free text, worth an embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean characters and words of a column that is prose for sure, and of one that may be. Fixed values.
CLEARLY, MAYBE = (60, 8), (24, 3)


def prose(text: Column) -> Column:
    """Aggregate: clearly, maybe or no. Means are whole numbers; the same sentence each time is a label."""
    said = F.when(F.trim(text) != "", text)
    n = F.count(said)
    chars = F.floor(F.sum(F.length(said)) / n)
    words = F.floor(F.sum(F.regexp_count(said, F.lit(r"\S+"))) / n)
    label = (F.count_distinct(said) < 2) & (n > 1)
    grade = F.lit("no")
    for name, (c, w) in (("maybe", MAYBE), ("clearly", CLEARLY)):
        grade = F.when((chars >= c) & (words >= w), F.lit(name)).otherwise(grade)
    return F.when((n == 0) | label, F.lit("no")).otherwise(grade)
