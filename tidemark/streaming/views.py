"""Incremental views: new rows of a source, through SQL and a worker, into a target, side outputs and alerts.

A pass takes rows after the view's cursor in arrival order, rebinds the source's name to just these rows, lands side
outputs, sends the alert, appends to the target, and moves the cursor last. A pass that is repeated lands the same rows
again, and their content is their key, so targets see each effect once; alerts are sent at least once. An aggregate in a
view's SQL is over one batch, of any size. Everything stays a DataFrame; a worker and an alert get at most ``MOST_BATCH``
rows at a time. What is larger goes to the worker in turns of their own, beside the rows: each turn has a copy of the worker.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Missing, Refused
from ..plans import sql
from ..schema import SEQ, Definition, check_name, visible
from ..sources.tables import Catalog
from .schedule import Alarm
from .workers import Context, checked_rows, turn

CURSORS, BATCH_ROWS, MOST_BATCH, MOST_PASSES = "_tm_cursors", 512, 100_000, 1000
#: Counts that the driver gets at once when it looks for the end of a large batch.
COUNTS = 4096
#: How a turn's outputs are kept: the table ("": the target), the turn, the place in it, the row as JSON. Alarms have no table.
STREAM, TURN, PLACE, VALUE = "stream", "turn", "place", "value"


@dataclass
class View:
    name: str
    source: str | None = None
    sql: str | None = None
    worker: object | None = None
    target: str | None = None
    alert: Callable[[list[dict]], bool] | None = None
    batch_rows: int = BATCH_ROWS
    cron: str | None = None
    every_seconds: int | None = None
    hosts: tuple[str, ...] = ()
    alarm: Alarm | None = field(default=None, repr=False)

    def __post_init__(self):
        check_name(self.name)
        if not self.sql and self.worker is None:
            raise Refused("a view has sql or a worker")
        if self.target is None and self.alert is None and self.worker is None:
            raise Refused("a view has a target or an alert")
        if self.batch_rows < 1:
            raise Refused("batch_rows is at least 1")
        if self.target is not None and self.target == self.source:
            raise Refused("a view doesn't write to its source")
        if self.cron and self.every_seconds is not None:
            raise Refused("a view has cron or every_seconds")
        if self.every_seconds is not None and self.every_seconds < 1:
            raise Refused("every_seconds is at least 1")
        if self.source is None and not ((self.cron or self.every_seconds) and self.worker is not None):
            raise Refused("a view without a source has a clock and a worker")


@dataclass
class Progress:
    rows: int = 0
    position: int = 0
    caught_up: bool = True
    written: int = 0


@dataclass
class Turns:
    """What a worker made in turns of its own: its outputs as text, in a folder that goes once they have landed."""

    kept: DataFrame
    path: str
    outputs: list[str]
    alarm_set: bool
    alarm_ms: int | None

    def of(self, stream: str) -> DataFrame:
        return self.kept.where(F.col(STREAM) == stream).orderBy(TURN, PLACE).select(VALUE)


@dataclass
class Held:
    """Rows after a position as they were found, in arrival order and kept; those before the cursor are done."""

    rows: DataFrame
    low: int
    high: int


def chunks(rows: Iterable, most: int) -> Iterator[list]:
    rows = iter(rows)
    while part := list(islice(rows, most)):
        yield part


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias(VALUE))


def last_of(rows: DataFrame, most: int) -> tuple[int, int]:
    """How many of the first so many rows there are, and the position of the last. Large numbers are counted out by ranges of
    positions, so that rows stay where they are."""
    if most <= MOST_BATCH:
        n, high = rows.orderBy(SEQ).limit(most).agg(F.count("*"), F.max(SEQ)).first()
        return n, high or 0
    n, low, high = rows.agg(F.count("*"), F.min(SEQ), F.max(SEQ)).first()
    if n <= most:
        return n, high or 0
    before = 0
    while low < high:
        width = -(-(high - low + 1) // COUNTS)
        inside = rows.where(F.col(SEQ).between(low, high)).groupBy(F.expr(f"({SEQ} - {low}L) div {width}L").alias("b")).count()
        for b, count in sorted((r["b"], r["count"]) for r in inside.collect()):
            if before + count >= most:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            before += count
    return most, low


class Views:
    def __init__(self, catalog: Catalog, functions=None, transport: Callable | None = None, clock: Callable[[], float] = time.time):
        self.catalog, self.functions, self.transport, self.clock = catalog, functions, transport, clock
        self.views: dict[str, View] = {}
        self.locks: dict[str, threading.Lock] = {}
        self.failed: dict[str, Exception] = {}
        self.held: dict[str, Held] | None = None
        catalog.define({"name": CURSORS, "columns": [{"name": "consumer", "kind": "string"}, {"name": "position", "kind": "int64"}, {"name": "updated_at", "kind": "int64"}], "primary_key": ["consumer"]}, "exist_ok")

    def define(self, view: View) -> View:
        self.views[view.name] = view
        self.locks.setdefault(view.name, threading.Lock())
        now = int(self.clock() * 1000)
        if view.cron:
            view.alarm = Alarm.on(view.cron, now)
        elif view.every_seconds:
            view.alarm = Alarm.interval(view.every_seconds, now)
        return view

    # cursors
    def cursor(self, name: str) -> int:
        row = self.catalog.table(CURSORS).snapshot().where(F.col("consumer") == name).select("position").first()
        return row.position if row else 0

    def _move(self, name: str, position: int) -> None:
        spark = self.catalog.spark
        table = self.catalog.table(CURSORS)
        table.append(spark.createDataFrame([(name, position, int(self.clock() * 1e6))], table.definition.schema))

    # passes
    def advance(self, name: str) -> Progress:
        """One pass; passes of a view don't overlap."""
        view = self.views[name]
        with self.locks[name]:
            if view.source is None:
                return self._clocked(view)
            if view.source not in self.catalog.names():
                return Progress()
            return self._pass(view)

    @contextmanager
    def _holding(self):
        """Within it, the rows that a view still has to see are found and sorted once, not in each pass."""
        outer = self.held
        self.held = {} if outer is None else outer
        try:
            yield
        finally:
            if outer is None:
                for h in self.held.values():
                    h.rows.unpersist()
            self.held = outer

    def _rest(self, view: View, at: int) -> DataFrame:
        """The rows after a position, in arrival order. Rows that came since they were found are found after these."""
        held = self.held.get(view.name)
        if held is None or at >= held.high or at < held.low:
            if held is not None:
                held.rows.unpersist()
            rows = self.catalog.table(view.source).since(at).repartitionByRange(SEQ).sortWithinPartitions(SEQ).persist()
            held = self.held[view.name] = Held(rows, at, rows.agg(F.max(SEQ)).first()[0] or 0)
        return held.rows.where(F.col(SEQ) > at)

    def _pass(self, view: View) -> Progress:
        at = self.cursor(view.name)
        with self._holding():
            rest = self._rest(view, at)
            n, high = last_of(rest, view.batch_rows)
            if not n:
                return Progress(position=at)
            made = self._through(view, rest.where(F.col(SEQ) <= high), n)
            try:
                written = self._land(view, *made)
            finally:
                if isinstance(made[1], Turns):
                    self.catalog.files.drop(made[1].path)
            self._move(view.name, high)
            return Progress(n, high, n < view.batch_rows, written)

    def _context(self, view: View, missed: int = 0) -> Context:
        return Context(view.source, int(self.clock() * 1000), tuple(view.hosts), self.transport, missed, alarm_ms=view.alarm.at_ms if view.alarm else None)

    def _through(self, view: View, batch: DataFrame, n: int) -> tuple[DataFrame | list[dict], Context | Turns | None]:
        rows: DataFrame | list[dict] = visible(batch)
        if view.sql:
            rows = sql.prepare(self.catalog, view.sql, self.functions, {view.source: batch})
        if view.worker is None:
            return rows, None
        ctx = self._context(view)
        # the view's SQL may make many rows of few
        given = [r[VALUE] for r in as_json(rows).limit(MOST_BATCH + 1).collect()] if n <= MOST_BATCH else None
        if given is not None and len(given) <= MOST_BATCH:
            return turn(view.worker, [json.loads(r) for r in given], ctx), ctx
        turns = self._turns(view, rows, ctx)
        return turns.of("") if "" in turns.outputs else [], turns

    def _turns(self, view: View, rows: DataFrame, ctx: Context) -> Turns:
        """The worker's turns over many rows, in the executors. Nothing lands before all of them have ended well."""
        worker = view.worker

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, MOST_BATCH):
                    part = batch.slice(at, MOST_BATCH)
                    own = Context(ctx.source, ctx.now_ms, ctx.hosts, ctx.transport, ctx.missed, alarm_ms=ctx.alarm_ms)
                    made = turn(worker, [json.loads(r) for r in part.column(1).to_pylist()], own)
                    out = [(stream, json.dumps(r)) for stream, part_rows in {**own.outputs, "": made}.items() for r in part_rows]
                    out += [(None, json.dumps(own.alarm_ms))] if own.alarm_set else []
                    first = part.column(0)[0].as_py()
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([first] * len(out), pa.int64()), pa.array(range(len(out)), pa.int32()), pa.array([x[1] for x in out], pa.string())], names=[STREAM, TURN, PLACE, VALUE])

        path = f"turns-{uuid.uuid4().hex}"
        whole = f"{self.catalog.files.root}/{path}"
        schema = f"{STREAM} string, {TURN} long, {PLACE} int, {VALUE} string"
        as_json(rows).select(F.monotonically_increasing_id().alias(TURN), VALUE).mapInArrow(run, schema).write.parquet(whole)
        kept = self.catalog.spark.read.schema(schema).parquet(whole)
        outputs = sorted(r[0] for r in kept.where(f"{STREAM} is not null").select(STREAM).distinct().collect())
        alarm = kept.where(f"{STREAM} is null").orderBy(F.desc(TURN)).first()
        return Turns(kept, path, outputs, alarm is not None, json.loads(alarm[VALUE]) if alarm else None)

    def _clocked(self, view: View) -> Progress:
        """A view without a source asks its worker when its alarm is due."""
        now = int(self.clock() * 1000)
        firing = view.alarm.begin(now) if view.alarm else None
        if firing is None:
            return Progress()
        try:
            ctx = self._context(view, firing.missed)
            entry = "alarm" if hasattr(view.worker, "alarm") else "batch"
            written = self._land(view, turn(view.worker, [], ctx, entry), ctx)
        except Exception:
            view.alarm.complete(firing, False, now)
            raise
        view.alarm.complete(firing, True, now)
        return Progress(written=written)

    def _land(self, view: View, made: DataFrame | list[dict], ctx: Context | Turns | None) -> int:
        """Effects in order: side outputs, alert, target, alarm. The caller moves the cursor after that."""
        if isinstance(ctx, Turns):
            for stream in ctx.outputs:
                if stream:
                    self._append(stream, ctx.of(stream), text=True)
        else:
            for stream, rows in (ctx.outputs if ctx else {}).items():
                self._append(stream, rows)
        text = isinstance(ctx, Turns) and not isinstance(made, list)
        if view.alert is not None:
            self._alert(view, made, text)
        written = self._append(view.target, made, text) if view.target else 0
        if ctx is not None and ctx.alarm_set:
            view.alarm = None if ctx.alarm_ms is None else Alarm.once(ctx.alarm_ms, (view.alarm.id if view.alarm else 0) + 1)
        return written

    def _alert(self, view: View, made: DataFrame | list[dict], text: bool) -> None:
        """All rows, so many at a time; the driver holds no more."""

        def send(rows: list[dict]) -> None:
            if not view.alert(rows):
                raise RuntimeError(f"the alert of {view.name} was not taken")

        if isinstance(made, list):
            for part in chunks(made, MOST_BATCH):
                send(part)
            return
        said = (made if text else as_json(made)).persist()
        try:
            said.count()  # all at once; the iterator would make one partition after another
            for part in chunks(said.toLocalIterator(), MOST_BATCH):
                send([json.loads(r[VALUE]) for r in part])
        finally:
            said.unpersist()

    def _append(self, target: str, made: DataFrame | list[dict], text: bool = False) -> int:
        """Into a table, which the first rows create with their schema. text: the frame's rows are JSON."""
        spark, there = self.catalog.spark, target in self.catalog.names()
        if isinstance(made, list):
            if not checked_rows(made):
                return 0
            made, text = spark.createDataFrame([(json.dumps(r),) for r in made], f"{VALUE} string").coalesce(1), True
        if text:
            schema = self.catalog.table(target).definition.schema if there else self._inferred(made)
            made = made.select(F.from_json(VALUE, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
        if not there:
            if made.isEmpty():
                return 0
            self.catalog.define(Definition.of(target, made.schema), "exist_ok")
        table = self.catalog.table(target)
        want = table.definition.schema
        made = made.select(*[(F.col(f"`{f.name}`") if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
        return table.append(made)

    def _inferred(self, text: DataFrame):
        """The schema that holds all of the JSON rows."""
        spark = self.catalog.spark
        rows = getattr(text.select(VALUE)._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        return DataFrame(spark._jsparkSession.read().json(rows), spark).schema

    def drain(self, name: str, passes: int | None = None) -> Progress:
        """Passes until the view has caught up, or so many."""
        if passes is not None and not 1 <= passes <= MOST_PASSES:
            raise Refused(f"passes is 1 to {MOST_PASSES}")
        total, done = Progress(), 0
        with self._holding():
            while passes is None or done < passes:
                p = self.advance(name)
                done += 1
                total = Progress(total.rows + p.rows, p.position, p.caught_up, total.written + p.written)
                if p.caught_up:
                    break
        return total

    def advance_all(self, budget: int | None = None) -> int:
        """Passes over all views in turn while any moves, or so many; a view that fails is left out and can be tried again later."""
        used, moved, out = 0, True, set()
        with self._holding():
            while moved and (budget is None or used < budget):
                moved = False
                for name in list(self.views):
                    if name in out or (budget is not None and used >= budget):
                        continue
                    try:
                        used += 1
                        p = self.advance(name)
                        self.failed.pop(name, None)
                        moved |= p.rows > 0
                    except Exception as e:  # noqa: BLE001  kept for the caller to see
                        self.failed[name] = e
                        out.add(name)
        return used

    def fetch(self, name: str, request: dict) -> dict:
        """A request to a view's worker; what it writes is landed before the reply."""
        view = self.views.get(name)
        if view is None or not hasattr(view.worker, "fetch"):
            raise Missing(f"no worker {name} takes requests")
        with self.locks[name]:
            ctx = self._context(view)
            reply = view.worker.fetch(request, ctx)
            for stream, rows in ctx.outputs.items():
                self._append(stream, rows)
            return reply

    def stream(self, name: str, path: str, schema, checkpoint: str, available_now: bool = True, seconds: float | None = None):
        """Drive a view from a Structured Streaming file source: each micro-batch is appended to its source, then drained."""
        view = self.views[name]

        def batch(df: DataFrame, _: int) -> None:
            self._append(view.source, df)
            self.drain(name)

        frame = self.catalog.spark.readStream.schema(schema).json(path)
        writer = frame.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds or 1} seconds")
        return writer.start()
