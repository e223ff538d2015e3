"""Search requests over a keyed table: filter, project, page, nearest vectors, full text."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.vector import DISTANCES
from ..schema import HIDDEN, SEQ, identity, visible
from ..sources.indexes import LENGTH, hits, lengths
from ..sources.tables import Table, newest
from .text import bm25, terms_of

NO_LIMIT = (1 << 63) // 2


@dataclass
class Search:
    filter: str | None = None
    columns: list[str] | None = None
    k: int | None = None
    offset: int = 0
    vector: list[float] | None = None
    vector_column: str | None = None
    distance_type: str | None = None
    full_text: str | dict | None = None
    nprobes: int = 20  # cells to read, where the column's index has cells
    refine_factor: int = 0  # taken and without effect: distances are of the vectors as they are
    ef: int | None = None  # likewise: there is no graph
    extra: dict = field(default_factory=dict)

    @classmethod
    def read(cls, body: dict) -> Search:
        if "order_by" in body:
            raise Refused("order_by is not supported; use SQL")
        known = {k: v for k, v in body.items() if k in cls.__dataclass_fields__ and k != "extra"}
        if odd := set(body) - set(known):
            raise Refused(f"unknown fields {sorted(odd)}")
        made = cls(**known)
        if made.vector is not None and made.vector and isinstance(made.vector[0], list | tuple):
            raise Refused("several vectors in one request are not supported")
        if made.columns is not None and not all(isinstance(c, str) for c in made.columns):
            raise Refused("columns are names; for expressions use SQL")
        return made


def vector_column(table: Table, named: str | None) -> tuple[str, int]:
    """The column to search and its width: the named one, or the only one."""
    wide = {c.name: c.width for c in table.definition.columns if c.width}
    if named is not None:
        if named not in wide:
            raise Refused(f"{named} is no vector column")
        return named, wide[named]
    if len(wide) != 1:
        raise Refused("there is no vector column" if not wide else f"there are several vector columns: {sorted(wide)}")
    return next(iter(wide.items()))


def metric_of(table: Table, column: str, asked: str | None) -> str:
    """The index's metric; another spelling in the request is refused."""
    own = table.definition.vector_indexes.get(column)
    if own and asked is not None and asked != own:
        raise Refused(f"{column} is indexed by {own}, not {asked}")
    metric = own or asked or "l2"
    if metric not in DISTANCES:
        raise Refused(f"no such distance: {metric}")
    return metric


def nearest(df: DataFrame, column: str, vector: list[float], metric: str, k: int, ties: list[str]) -> DataFrame:
    """The k rows with the smallest ``_distance``: a top-k per partition, then of those."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    distance = DISTANCES[metric](F.col(f"`{column}`"), query)
    return df.withColumn("_distance", distance).where("_distance is not null").orderBy("_distance", *ties).limit(k)


def attached(df: DataFrame, found: DataFrame, keys: list[str], order: list, k: int | None, filtered: bool) -> DataFrame:
    """Current rows of df with what was found for them, the first k in order.

    Without a filter the choice is made among what was found, which holds current rows only, and just those rows are read.
    """
    if k is not None and not filtered:
        found = found.orderBy(*order).limit(k)
    quoted = [f"`{c}`" for c in keys]
    few = df.join(found.select(*quoted), keys, "left_semi") if k is not None and not filtered else df
    out = few.join(found, keys).orderBy(*order)
    return out if k is None else out.limit(k)


def live(found: DataFrame, manifest: dict, current: DataFrame, keys: list[str]) -> DataFrame:
    """What was found of rows that no newer row supersedes."""
    whole = manifest["generations"]
    if len(whole) == 1 and whole[0]["unique"]:
        return found
    return found.join(current.select(*[f"`{c}`" for c in keys]), keys, "left_semi")


def by_vector(table: Table, df: DataFrame, r: Search, manifest: dict, k: int) -> DataFrame:
    """The k nearest rows of df: of the cells that are read, where there are any; of all cells if those hold fewer than k."""
    column, width = vector_column(table, r.vector_column)
    if len(r.vector) != width:
        raise Refused(f"{column} has {width} components, the query {len(r.vector)}")
    metric, ties = metric_of(table, column, r.distance_type), identity(table.definition)
    read = table.probe(column, r.vector, r.nprobes, manifest) if k else None
    if read is None:
        return nearest(df, column, r.vector, metric, k, ties)
    keys, query = [*ties, SEQ], F.array(*[F.lit(float(x)) for x in r.vector])

    def of(cells: DataFrame) -> DataFrame:
        distance = DISTANCES[metric](F.col(f"`{column}`"), query)
        found = cells.withColumn("_distance", distance).where("_distance is not null").drop(column)
        return attached(df, live(found, manifest, table.frame(manifest), keys), keys, ["_distance", *[f"`{c}`" for c in ties]], k, bool(r.filter))

    made, whole = of(read[0]), read[1]
    if not whole and made.count() < k:
        made = of(table.probe(column, r.vector, NO_LIMIT, manifest)[0])
    return made


def by_text(table: Table, df: DataFrame, r: Search, manifest: dict, columns: list[str], query: str, k: int | None) -> DataFrame:
    """Rows of df that hold any term in any of the columns, best ``_score`` first, from the stored postings.

    Scores are BM25 with the figures of all current rows, whatever the filter.
    """
    ties, terms = identity(table.definition), terms_of(query)
    keys, parts = [*ties, SEQ], []
    for c in columns if terms else []:
        stored = table.postings(c, manifest)
        if stored is not None:
            every = lengths(stored).select(LENGTH, *[f"`{x}`" for x in keys])
            single = len(manifest["generations"]) == 1 and manifest["generations"][0]["unique"]
            current = every if single else newest(every, ties)
            parts.append(bm25(live(hits(stored, terms, ties), manifest, current, keys), current, keys))
    if not parts:
        return df.withColumn("_score", F.lit(0.0)).limit(0)
    scores = reduce(DataFrame.unionByName, parts)
    scores = scores.groupBy(*[f"`{c}`" for c in keys]).agg(F.sum("_score").alias("_score"))
    return attached(df, scores, keys, [F.desc("_score"), *[f"`{c}`" for c in ties]], k, bool(r.filter))


def search(table: Table, request: Search | dict) -> DataFrame:
    r = request if isinstance(request, Search) else Search.read(request)
    if r.vector is not None and r.full_text is not None:
        raise Refused("a request has a vector or a text, not both")
    manifest = table.manifest()
    df, ties = table.frame(manifest), identity(table.definition)
    for c in r.columns or []:
        if c not in df.columns or c in HIDDEN:
            raise Refused(f"no column {c}")
    if r.filter:
        df = df.where(r.filter)  # before the top-k, so k rows that pass are found if there are
    more = []
    if r.vector is not None:
        k = 10 if r.k is None else r.k
        df, more = by_vector(table, df, r, manifest, k + r.offset), ["_distance"]
        df = df.orderBy("_distance", *ties).offset(r.offset) if r.offset else df
    elif r.full_text is not None:
        asked = {"query": r.full_text} if isinstance(r.full_text, str) else r.full_text
        columns = asked.get("columns") or table.definition.text_indexes
        if not columns or (odd := [c for c in columns if c not in table.definition.text_indexes]):
            raise Refused(f"no text index on {odd if columns else 'any column'}")
        k = (10 if r.k is None else r.k) + r.offset
        df, more = by_text(table, df, r, manifest, columns, asked["query"], k if k < NO_LIMIT else None), ["_score"]
        df = df.orderBy(F.desc("_score"), *ties).offset(r.offset) if r.offset else df
    elif r.offset or (r.k is not None and r.k < NO_LIMIT):
        df = df.orderBy(SEQ)
        df = df.offset(r.offset) if r.offset else df
        df = df.limit(r.k) if r.k is not None and r.k < NO_LIMIT else df
    return visible(df.select(*r.columns, *more)) if r.columns else visible(df)
