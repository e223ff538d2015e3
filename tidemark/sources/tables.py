"""Keyed tables: immutable Parquet generations behind a versioned manifest; the newest row of a key counts.

A manifest version is a file that is created only if it isn't there, so two writers can't both commit one. A snapshot is
the generations of one version. Only predicates on the key may pass below the choice of the newest row; Catalyst moves
just those.
"""

from __future__ import annotations

import time
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import Conflict, Missing, Refused
from ..schema import KEY, SEQ, Definition, check_name, conform, content_key, identity, visible
from . import indexes
from .files import Files

#: From so many generations on, an append compacts.
COMPACT_AT = 8
SCAN_LIMIT = 1_000_000


def newest(df: DataFrame, keys: list[str], seq: str = SEQ) -> DataFrame:
    """The row with the highest seq of each key."""
    turn = F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(F.col(seq).desc()))
    return df.withColumn("_tm_turn", turn).where("_tm_turn = 1").drop("_tm_turn")


class Table:
    def __init__(self, catalog: Catalog, definition: Definition):
        self.catalog, self.definition = catalog, definition
        self.spark, self.files = catalog.spark, catalog.files
        self.home = f"data/{definition.name}"

    # manifests
    def manifest(self) -> dict:
        names = [n for n in self.files.names(f"{self.home}/manifest") if n.endswith(".json")]
        return self.files.read(f"{self.home}/manifest/{names[-1]}") if names else {"version": 1, "generations": [], "high": 0}

    def _commit(self, base: dict, **changes) -> dict:
        made = {**base, **changes, "version": changes.get("version", base["version"] + 1), "commit": base.get("commit", 0) + 1}
        if not self.files.create(f"{self.home}/manifest/{made['commit']:012d}.json", made):
            raise Conflict(f"{self.definition.name} was written by another writer")
        return made

    # reading
    def _rows(self, generations: list[dict]) -> DataFrame:
        """All rows of the generations, superseded ones too."""
        schema = self.definition.schema.add(KEY, "string").add(SEQ, "long") if not self.definition.primary_key else self.definition.schema.add(SEQ, "long")
        if not generations:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._at(g["path"]) for g in generations])

    def _at(self, path: str) -> str:
        return f"{self.files.root}/{self.home}/{path}"

    def _read(self, generations: list[dict]) -> DataFrame:
        df = self._rows(generations)
        if not generations:
            return df
        return df if len(generations) == 1 and generations[0]["unique"] else newest(df, identity(self.definition))

    def frame(self, manifest: dict | None = None) -> DataFrame:
        """A snapshot with hidden columns; later writes don't show."""
        return self._read((manifest or self.manifest())["generations"])

    def snapshot(self) -> DataFrame:
        return visible(self.frame())

    def since(self, cursor: int) -> DataFrame:
        """Rows that arrived after a position. Generations that end before it hold none, and none that supersede these."""
        return self._read([g for g in self.manifest()["generations"] if g["max_seq"] > cursor]).where(F.col(SEQ) > cursor)

    def scan(self, where: str | None = None, limit: int = SCAN_LIMIT) -> DataFrame:
        df = self.frame()
        df = df.where(where) if where else df
        return visible(df.limit(min(limit, SCAN_LIMIT)))

    def count_rows(self, where: str | None = None) -> int:
        df = self.frame()
        return (df.where(where) if where else df).count()

    def describe(self) -> dict:
        return {"name": self.definition.name, "version": self.manifest()["version"], "schema": self.definition.schema}

    def stats(self) -> list[dict]:
        return [{k: g[k] for k in ("path", "rows", "min_seq", "max_seq")} | {"indexes": sorted([*self.definition.vector_indexes, *self.definition.text_indexes])} for g in self.manifest()["generations"]]

    # writing
    def append(self, df: DataFrame, if_version: int | None = None, compact: bool = True) -> int:
        """Add rows in the frame's order; gives how many. if_version: only if the table is still at that version."""
        base = self.manifest()
        if if_version is not None and base["version"] != if_version:
            raise Conflict(f"{self.definition.name} is at version {base['version']}, not {if_version}")
        rows = conform(df, self.definition)
        start = max(base["high"], int(time.time() * 1e6)) + 1
        rows = rows if self.definition.primary_key else rows.withColumn(KEY, content_key(self.definition))
        rows = rows.withColumn(SEQ, F.monotonically_increasing_id() + F.lit(start))
        path = f"g-{uuid.uuid4().hex}"
        whole = f"{self.files.root}/{self.home}/{path}"
        rows.write.parquet(whole)
        n, low, high = self.spark.read.schema(rows.schema).parquet(whole).agg(F.count("*"), F.min(SEQ), F.max(SEQ)).first()
        if not n:
            self.files.drop(f"{self.home}/{path}")
            return 0
        made = self._indexed({"path": path, "rows": n, "min_seq": low, "max_seq": high, "unique": False}, base)
        try:
            base = self._commit(base, generations=[*base["generations"], made], high=high)
        except Conflict:
            self.files.drop(f"{self.home}/{path}")
            raise
        if compact and len(base["generations"]) >= COMPACT_AT:
            self.compact()
        return n

    def flush(self) -> dict:
        """Appends are durable when they return; gives the current manifest."""
        return self.manifest()

    def compact(self, least: int = 2) -> bool:
        """Merge generations into one that holds each key once. Old files stay until ``vacuum``, for readers of older snapshots."""
        base = self.manifest()
        if len(base["generations"]) < least:
            return False
        rows, path = self.frame(base), f"g-{uuid.uuid4().hex}"
        whole = f"{self.files.root}/{self.home}/{path}"
        rows.write.parquet(whole)
        n, low, high = self.spark.read.schema(rows.schema).parquet(whole).agg(F.count("*"), F.min(SEQ), F.max(SEQ)).first()
        made = self._indexed({"path": path, "rows": n, "min_seq": low, "max_seq": high, "unique": True}, base)
        self._commit(base, generations=[made], version=base["version"])
        return True

    def vacuum(self, older_than_s: float = 120.0) -> int:
        """Delete generations that no current manifest names and that are old enough for no reader to need them."""
        live = {path for g in self.manifest()["generations"] for path in (g["path"], *g.get("text", {}).values(), *(x["path"] for x in g.get("cells", {}).values()))}
        gone = 0
        for name in self.files.names(self.home):
            if name.startswith(("g-", "x-")) and name not in live:
                at = self.files.path(f"{self.home}/{name}")
                if time.time() - self.files.fs.getFileStatus(at).getModificationTime() / 1000 >= older_than_s:
                    self.files.drop(f"{self.home}/{name}")
                    gone += 1
        return gone

    def warm(self) -> DataFrame:
        return self.frame().persist()

    # indexes
    def _put(self, df: DataFrame) -> str:
        path = f"x-{uuid.uuid4().hex}"
        df.write.parquet(self._at(path))
        return path

    def _indexed(self, generation: dict, base: dict) -> dict:
        """The generation with what the table's indexes hold of it; what is there already stays."""
        ident = [*identity(self.definition), SEQ]
        text = dict(generation.get("text", {}))
        for c in self.definition.text_indexes:
            if c not in text:
                kept = indexes.counted(self._rows([generation]), ident, c).persist(StorageLevel.DISK_ONLY)
                try:
                    text[c] = self._put(indexes.filed(kept, ident))
                finally:
                    kept.unpersist()
        held = dict(generation.get("cells", {}))
        for c, spec in base.get("centres", {}).items():
            if held.get(c, {}).get("of") != spec["name"]:
                known = self.files.read(f"{self.home}/{spec['name']}")
                held[c] = {"of": spec["name"], "path": self._put(indexes.cells(self._rows([generation]), ident, c, known["metric"], known["centres"]))}
        return {**generation, "text": text, "cells": held}

    def index_vector(self, column: str, metric: str, cells: int | None = None) -> None:
        """Searches on the column use this metric from now on. cells: also sort the vectors into that many cells (0: about the
        root of the number of rows), of which a search reads its ``nprobes`` nearest; without, searches are exact. A column
        that has cells gets new ones, of the metric, for all generations before this returns."""
        if not next((c.width for c in self.definition.columns if c.name == column), None):
            raise Refused(f"{column} is no vector column")
        self.definition.vector_indexes[column] = metric
        checked = Definition.from_dict(self.definition.to_dict())
        base = self.manifest()
        own = base.get("centres", {}).get(column)
        if cells is not None or own:
            cells = own["cells"] if cells is None else cells
            rows = sum(g["rows"] for g in base["generations"])
            name = f"centres-{uuid.uuid4().hex}.json"
            fitted = indexes.fit_centres(self._rows(base["generations"]), column, metric, cells or None, rows)
            self.files.create(f"{self.home}/{name}", {"metric": metric, "centres": fitted})
            spec = {**base, "centres": {**base.get("centres", {}), column: {"name": name, "cells": cells}}}
            self._commit(base, generations=[self._indexed(g, spec) for g in base["generations"]], centres=spec["centres"], version=base["version"])
        self.catalog.store(checked)

    def index_text(self, column: str) -> None:
        """Write the column's postings for all generations; later ones get theirs as they are written."""
        kinds = {f.name: f.dataType.simpleString() for f in self.definition.schema}
        if kinds.get(column) != "string":
            raise Refused(f"{column} is no text column")
        if column not in self.definition.text_indexes:
            self.definition.text_indexes.append(column)
            base = self.manifest()
            if base["generations"]:
                self._commit(base, generations=[self._indexed(g, base) for g in base["generations"]], version=base["version"])
            self.catalog.store(self.definition)

    def postings(self, column: str, manifest: dict) -> DataFrame | None:
        """The stored postings of a snapshot; those of a generation that another writer added without are made as they are read."""
        stored = [g["text"][column] for g in manifest["generations"] if column in g.get("text", {})]
        rest = [g for g in manifest["generations"] if column not in g.get("text", {})]
        parts = [self.spark.read.parquet(*map(self._at, stored))] if stored else []
        parts += [indexes.postings(self._rows(rest), [*identity(self.definition), SEQ], column)] if rest else []
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else None

    def probe(self, column: str, vector: list[float], nprobes: int, manifest: dict) -> tuple[DataFrame, bool] | None:
        """Identity and vector of the rows in the nearest cells, and whether those are all; None without cells for the whole snapshot."""
        spec = manifest.get("centres", {}).get(column)
        held = [g.get("cells", {}).get(column, {}) for g in manifest["generations"]]
        if not spec or not held or any(h.get("of") != spec["name"] for h in held):
            return None
        known = self.files.read(f"{self.home}/{spec['name']}")
        asked = indexes.probed(known["centres"], vector, known["metric"], nprobes)
        df = self.spark.read.parquet(*[self._at(h["path"]) for h in held])
        return df.where(F.col(indexes.CELL).isin(asked)).drop(indexes.CELL), len(asked) > len(known["centres"])

    def indexes(self) -> list[dict]:
        cells = self.manifest().get("centres", {})
        return [{"column": c, "kind": "vector", "metric": m, "cells": c in cells} for c, m in self.definition.vector_indexes.items()] + [{"column": c, "kind": "text"} for c in self.definition.text_indexes]


class Catalog:
    """Definitions in ``catalog/`` and data in ``data/`` under one root, which may be any store that Hadoop reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def store(self, definition: Definition) -> None:
        self.files.replace(f"catalog/{definition.name}.json", definition.to_dict())

    def define(self, definition: Definition | dict, mode: str = "create") -> Table:
        """mode: create, exist_ok (the same shape may be there) or overwrite (drop, then create)."""
        definition = definition if isinstance(definition, Definition) else Definition.from_dict(definition)
        if mode not in ("create", "exist_ok", "overwrite"):
            raise Refused(f"no such mode: {mode}")
        if mode == "overwrite" and definition.name in self.names():
            self.drop(definition.name)
        if self.files.create(f"catalog/{definition.name}.json", definition.to_dict()):
            return Table(self, definition)
        own = self.table(definition.name)
        if mode == "exist_ok" and own.definition.shape() == definition.shape():
            return own
        raise Refused(f"{definition.name} exists" + " with another shape" * (mode == "exist_ok"))

    def create(self, name: str, df: DataFrame, primary_key: list[str] | None = None, mode: str = "create", widths: dict[str, int] | None = None) -> Table:
        """A table with the frame's schema and rows."""
        table = self.define(Definition.of(name, df.schema, primary_key, widths), mode)
        table.append(df)
        return table

    def names(self) -> list[str]:
        return [n.removesuffix(".json") for n in self.files.names("catalog") if n.endswith(".json")]

    def list(self, limit: int | None = None, page_token: str | None = None) -> tuple[list[str], str | None]:
        """Sorted names after the token, and the token of the next page. Names that begin with _ don't show."""
        names = [n for n in self.names() if not n.startswith("_") and (page_token is None or n > page_token)]
        page = names[:limit] if limit is not None else names
        return page, page[-1] if len(page) < len(names) and page else None

    def table(self, name: str) -> Table:
        data = self.files.read(f"catalog/{check_name(name)}.json")
        if data is None:
            raise Missing(f"no table {name}")
        return Table(self, Definition.from_dict(data, strict=False))

    def drop(self, name: str) -> None:
        if name not in self.names():
            raise Missing(f"no table {name}")
        self.files.drop(f"catalog/{name}.json")
        self.files.drop(f"data/{name}")
