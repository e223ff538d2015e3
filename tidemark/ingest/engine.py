"""Ingest of any JSON: raw first, then routed, the rule evolved, and rows appended, or the table made again from raw.

Raw records (bronze) are written before anything is decided, so nothing after that can lose one. A live table never
gains a column: it is dropped and made again, in one job, from its sources' raw records less the quarantined ones.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.models import distinct_first, embed_function
from ..schema import SEQ, Column, Definition
from ..sources.tables import Catalog, Table
from . import literals
from .literals import STORED
from .prose import prose
from .rules import BRONZE, EXTRA, HISTORY, ID, QUARANTINE, Change, Judge, NoJudge, Rule, design, evolve, key_refusal, mapped, matching, profile, valid_source

SYSTEM = {
    BRONZE: {"name": BRONZE, "columns": [{"name": ID, "kind": "string"}, {"name": "source", "kind": "string"}, {"name": "received_at", "kind": "int64"}, {"name": "record", "kind": "string"}], "primary_key": [ID]},
    QUARANTINE: {"name": QUARANTINE, "columns": [{"name": ID, "kind": "string"}, {"name": "source", "kind": "string"}, {"name": "table_name", "kind": "string"}, {"name": "reason", "kind": "string"}, {"name": "record", "kind": "string"}], "primary_key": [ID]},
}
SUFFIX = "_embedding"


@dataclass
class Report:
    source: str
    table: str
    created: bool = False
    accepted: int = 0
    quarantined: int = 0
    rescued: int = 0
    rebuilt: bool = False
    embedded: int = 0
    unembedded: int = 0
    changes: list[Change] = field(default_factory=list)


def record_id(source, record):
    """16 bytes of a digest over the source and the raw bytes, in hex."""
    return F.substring(F.sha2(F.concat(source.cast("binary"), F.lit(b"\0"), record.cast("binary")), 256), 1, 32)


class Ingest:
    """embedder: for prose columns, an object with ``embed`` and ``width``; judge: answers typed questions."""

    def __init__(self, catalog: Catalog, judge: Judge | None = None, embedder=None):
        self.catalog, self.judge, self.embedder = catalog, judge or NoJudge(), embedder
        self.spark, self.files = catalog.spark, catalog.files
        for d in SYSTEM.values():
            catalog.define(d, "exist_ok")

    # rules and routes
    def rule(self, table: str) -> Rule | None:
        found = self.files.read(f"ingest/tables/{table}.json")
        return Rule.from_dict(found) if found else None

    def rules(self) -> list[Rule]:
        return [self.rule(n.removesuffix(".json")) for n in self.files.names("ingest/tables")]

    def _save(self, rule: Rule) -> None:
        self.files.replace(f"ingest/tables/{rule.table}.json", rule.to_dict())

    # entry points
    def body(self, source: str, text: str) -> Report:
        """A request's body: an array, one record, or ``{"records": [...]}``."""
        return self.records(source, literals.split_records(text))

    def records(self, source: str, raws: Iterable[str]) -> Report:
        """Raw records, one JSON value each, in order."""
        rows = [(i, r) for i, r in enumerate(raws)]
        return self.frame(source, self.spark.createDataFrame(rows, "n long, record string").orderBy("n").select("record"))

    def frame(self, source: str, records: DataFrame) -> Report:
        """A frame with a column ``record`` of raw JSON values: the way for large feeds."""
        if not valid_source(source):
            raise Refused("a source is 1 to 128 letters, digits, '.', '_' or '-'")
        bronze = self.catalog.table(BRONZE)
        before = bronze.manifest()["high"]
        named = F.lit(source)
        n = bronze.append(records.select(record_id(named, F.col("record")).alias(ID), named.alias("source"), F.lit(int(time.time() * 1e6)).alias("received_at"), "record"))
        if not n:
            raise Refused("send at least one record")
        # read once: what is decided, refused and written from it needs it several times
        kept = f"ingest/arrived-{uuid.uuid4().hex}"
        whole = f"{self.files.root}/{kept}"
        try:
            made = self._read(bronze.since(before)).withColumn("object", F.col("fields").isNotNull())
            made.write.parquet(whole)
            return self._place(source, self.spark.read.schema(made.schema).parquet(whole), before)
        finally:
            self.files.drop(kept)

    def _read(self, raw: DataFrame) -> DataFrame:
        return raw.select(F.col(ID).alias("id"), "source", "record", F.col(SEQ).alias("at"), literals.fields_once("record").alias("fields"))

    def _place(self, source: str, arrived: DataFrame, before: int) -> Report:
        objects = arrived.where("object")
        total = objects.count()
        route = self.files.read(f"ingest/routes/{source}.json")
        created, changes = False, []
        if route:
            rule = self.rule(route["table"])
        else:
            facts = profile(objects)
            rule, changes = self._routed(source, objects, facts, total)
            created = rule.version == 0
            self._save(rule)
            self.files.create(f"ingest/routes/{source}.json", {"source": source, "table": rule.table})
        if source not in rule.sources:
            rule.sources.append(source)
        # a rule made from these very records has a column for each field, and every value fits it
        more, reshaped, refuse = ([], False, key_refusal(rule)) if created else evolve(rule, objects, self.judge)
        changes += more
        added, notes = self._plan_embeddings(rule, objects)
        changes += notes
        judged = arrived.withColumn("reason", F.when(~F.col("object"), F.lit("not a JSON object")).otherwise(refuse))
        bad = judged.where(F.col("reason").isNotNull()).orderBy("at")
        refused_before = self.catalog.table(QUARANTINE).manifest()["high"]
        quarantined = self.catalog.table(QUARANTINE).append(bad.select(F.col("id").alias(ID), "source", F.lit(rule.table).alias("table_name"), "reason", "record"))
        good = judged.where(F.col("reason").isNull()).drop("reason")
        report = Report(source, rule.table, created, arrived.count() - quarantined, quarantined, changes=changes)
        rule.history = [*rule.history, *changes][-HISTORY:]
        report.rebuilt = created or reshaped or added
        rule.version += report.rebuilt
        self._save(rule)
        report.rescued = mapped(rule, good).where(F.col(EXTRA).isNotNull()).count()
        if report.rebuilt:
            table = self.rebuild(rule, (good, before, refused_before))
        else:
            table = self.catalog.table(rule.table)
            table.append(self._silver(rule, good.orderBy("at"), table))
        if rule.embeddings:
            counts = [F.count_if(F.col(c + SUFFIX).isNotNull()).alias(f"a{i}") for i, c in enumerate(rule.embeddings)] + [F.count_if(F.col(c + SUFFIX).isNull() & F.col(c).isNotNull()).alias(f"b{i}") for i, c in enumerate(rule.embeddings)]
            row = table.snapshot().agg(*counts).first()
            half = len(rule.embeddings)
            report.embedded, report.unembedded = sum(row[:half]), sum(row[half:])
        return report

    def _routed(self, source: str, objects: DataFrame, facts: dict, total: int) -> tuple[Rule, list[Change]]:
        from ..functions.questions import Question
        from .rules import NEW, sure

        fitting = matching(self.rules(), facts, objects)
        if fitting:
            asked = {"route": Question("choice", "Which table holds records of this kind?", [*(r.table for r in fitting), NEW])}
            said = sure(self.judge.ask({"source": source, "fields": facts}, asked), "route")
            if said and (rule := next((r for r in fitting if r.table == said[0]), None)):
                rule.sources.append(source)
                return rule, [Change(f"route {source}", rule.table, "judge", said[1])]
        return design(source, objects, facts, total, set(self.catalog.names()), self.judge)

    # silver
    def _definition(self, rule: Rule) -> Definition:
        key = rule.primary_key or ID
        kinds = [Column(c.name, STORED.get(c.kind, c.kind), c.name != key) for c in rule.columns]
        vectors = [Column(c + SUFFIX, f"vector:{self.embedder.width}") for c in rule.embeddings] if self.embedder else []
        return Definition(rule.table, [Column(ID, "string", ID != key), *kinds, Column(EXTRA, "string"), *vectors], [key], vector_indexes={v.name: "cosine" for v in vectors})

    def _silver(self, rule: Rule, records: DataFrame, old: Table | None = None) -> DataFrame:
        """Typed rows of records in arrival order, with vectors; of texts that the old table has, its vectors are taken over."""
        rows = mapped(rule, records)
        for c in rule.embeddings if self.embedder else []:
            name = c + SUFFIX
            held = None
            if old is not None and name in [x.name for x in old.definition.columns]:
                held = old.snapshot().where(f"`{name}` is not null").groupBy(F.col(c).alias("_t")).agg(F.first(name).alias("_held"))
            if held is None:
                rows = distinct_first(rows, c, embed_function(self.embedder), name)
            else:
                todo = rows.select(F.col(c).alias("_t")).where("_t is not null").distinct().join(held, "_t", "left_anti")
                fresh = todo.withColumn("_held", embed_function(self.embedder)(F.col("_t")))
                rows = rows.join(held.unionByName(fresh), F.col(c) == F.col("_t"), "left").drop("_t").withColumnRenamed("_held", name)
        return rows

    def rebuild(self, rule: Rule, latest: tuple[DataFrame, int, int] | None = None) -> Table:
        """The table made again from raw records, in one job. latest: accepted records that have been read already, and the
        positions in the raw and the refused layer before they came."""
        old = self.catalog.table(rule.table) if rule.table in self.catalog.names() else None
        refused = self.catalog.table(QUARANTINE).frame().where(F.col("table_name") == rule.table)
        good, before, refused_before = latest or (None, None, None)
        parts = []
        if before != 0:
            raw = self.catalog.table(BRONZE).frame().where(F.col("source").isin(rule.sources))
            raw = raw if before is None else raw.where(F.col(SEQ) <= before)
            # sorted before they are read: a sort looks at its rows twice
            raw = raw.join(refused.select(ID), ID, "left_anti").orderBy(SEQ)
            parts.append(self._read(raw).where(F.col("fields").isNotNull()))
        if good is not None:
            again = refused.where(F.col(SEQ) <= refused_before).select(F.col(ID).alias("id"))
            parts.append((good.join(again, "id", "left_anti") if refused_before else good).select("id", "source", "record", "at", "fields").orderBy("at"))
        rows = self._silver(rule, parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0], old)
        if old is not None:  # what it reads must not go before the new table is written
            kept = f"{self.files.root}/ingest/rebuild-{rule.table}-{rule.version}"
            rows.write.mode("overwrite").parquet(kept)
            rows = self.spark.read.schema(rows.schema).parquet(kept)
            table = self.catalog.define(self._definition(rule), "overwrite")
            table.append(rows)
            self.files.drop(f"ingest/rebuild-{rule.table}-{rule.version}")
            return table
        table = self.catalog.define(self._definition(rule))
        table.append(rows)
        return table

    # embeddings
    def _plan_embeddings(self, rule: Rule, objects: DataFrame) -> tuple[bool, list[Change]]:
        """Text columns that are prose get a vector column; those that may be, if the judge says so. Each is decided once."""
        from ..functions.questions import Question
        from .rules import sure

        todo = [c for c in rule.columns if c.kind == "string" and c.name not in rule.considered]
        if self.embedder is None or not todo:
            return False, []
        grades = objects.agg(*[prose(c.value()["text"]).alias(f"g{i}") for i, c in enumerate(todo)]).first()
        changes, added = [], False
        for i, c in enumerate(todo):
            grade = grades[f"g{i}"]
            rule.considered.append(c.name)
            if grade == "maybe":
                said = sure(self.judge.ask({"field": c.name}, {"embed": Question("noul", f"Is {c.name} free text?")}), "embed")
                yes, by = bool(said and said[0] >= 0.5), (("judge", said[1]) if said else ())
            else:
                yes, by = grade == "clearly", ()
            if yes:
                rule.embeddings.append(c.name)
                changes.append(Change(f"embedding of {c.name}", c.name + SUFFIX, *by))
                added = True
        return added, changes

    def repair(self, table: str, most: int = 256) -> int:
        """Fill vectors that an earlier request couldn't get, for so many rows at most; gives how many."""
        rule, own = self.rule(table), self.catalog.table(table)
        filled = 0
        for c in rule.embeddings if self.embedder else []:
            missing = own.frame().where(F.col(c).isNotNull() & F.col(c + SUFFIX).isNull()).orderBy(SEQ).limit(most).drop(SEQ)
            rows = missing.drop(c + SUFFIX).withColumn(c + SUFFIX, embed_function(self.embedder)(F.col(c)))
            filled += own.append(rows.select(*[x.name for x in own.definition.columns]))
        return filled

