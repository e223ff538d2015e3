"""JSON rows and Arrow bytes in and out, and a streaming source for sockets that push text frames."""

from __future__ import annotations

import json
import queue
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..errors import Refused
from ..schema import Definition

ARROW_FILE, RESULT_BYTES = b"ARROW1", 8 << 20
#: Text frames in a batch, its longest wait in seconds, and the pauses before a lost socket is opened again. Fixed values.
FRAMES, MOST_FRAMES, WINDOW_S, FIRST_PAUSE_S, LONGEST_PAUSE_S = 256, 10_000, 1.0, 1.0, 60.0

_TAKES = {
    "string": lambda v: isinstance(v, str), "json": lambda v: isinstance(v, str), "int64": lambda v: isinstance(v, int) and not isinstance(v, bool), "float64": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool), "decimal": lambda v: isinstance(v, int | float | str) and not isinstance(v, bool), "timestamp": lambda v: isinstance(v, str | int) and not isinstance(v, bool),
}


def json_rows(spark: SparkSession, definition: Definition, body: str | dict) -> DataFrame:
    """``{"rows": [...]}`` as a frame of the table's columns; unknown columns and values of another kind are refused."""
    data = json.loads(body) if isinstance(body, str) else body
    if not isinstance(data, dict) or set(data) != {"rows"} or not isinstance(data["rows"], list):
        raise Refused('a body is {"rows": [...]}')
    kinds = {c.name: c for c in definition.columns}
    for i, row in enumerate(data["rows"]):
        if not isinstance(row, dict):
            raise Refused(f"row {i} is not an object")
        for name, value in row.items():
            if name not in kinds:
                raise Refused(f"row {i} has an unknown column {name}")
            if value is not None and not _TAKES.get(kinds[name].kind, lambda v: False)(value):
                raise Refused(f"row {i}: {name} is no {kinds[name].kind}")
        if missing := [c.name for c in definition.columns if not c.nullable and row.get(c.name) is None]:
            raise Refused(f"row {i} lacks {missing}")
    made = [F.col(f"`{c.name}`").cast(definition.schema[c.name].dataType).alias(c.name) for c in definition.columns]
    plain = ", ".join(f"`{c.name}` {'double' if c.kind == 'float64' else 'long' if c.kind == 'int64' else 'boolean' if c.kind == 'boolean' else 'string'}" for c in definition.columns)
    rows = []
    for row in data["rows"]:
        out = []
        for c in definition.columns:
            v = row.get(c.name)
            if v is not None and c.kind == "float64":
                v = float(v)
            elif v is not None and c.kind == "timestamp" and isinstance(v, int):
                v = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(v // 1_000_000)) + f".{v % 1_000_000:06d}"
            elif v is not None and c.kind == "decimal":
                v = str(v)
            out.append(v)
        rows.append(tuple(out))
    return spark.createDataFrame(rows, plain).select(*made)


def arrow_stream(spark: SparkSession, body: bytes) -> DataFrame:
    """A frame of an Arrow IPC stream; the file format is refused."""
    if body[:6] == ARROW_FILE:
        raise Refused("send the Arrow stream format, not the file format")
    return spark.createDataFrame(pa.ipc.open_stream(body).read_all())


def arrow_file(df: DataFrame) -> bytes:
    """A frame's rows in the Arrow IPC file format."""
    table, sink = df.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def json_array(df: DataFrame, most: int = RESULT_BYTES) -> str:
    """A frame's rows as a JSON array of at most so many bytes."""
    parts, size = [], 2
    for row in df.toJSON().toLocalIterator():
        size += len(row.encode()) + 1
        if size > most:
            raise Refused(f"the result has more than {most} bytes")
        parts.append(row)
    return f"[{','.join(parts)}]"


class Frames:
    """Text frames of a connection, in batches by number or time; a lost connection is opened again, after growing pauses.

    connect gives an iterator of str and bytes; binary frames are dropped.
    """

    def __init__(self, connect: Callable[[], Iterator[str | bytes]], frames: int = FRAMES, window_s: float = WINDOW_S, sleep: Callable[[float], None] = time.sleep):
        if not 1 <= frames <= MOST_FRAMES:
            raise Refused(f"frames is 1 to {MOST_FRAMES}")
        self.connect, self.frames, self.window_s, self.sleep = connect, frames, window_s, sleep
        self.held: queue.Queue = queue.Queue(4 * frames)
        self.closed = threading.Event()

    def start(self) -> Frames:
        threading.Thread(target=self._run, daemon=True).start()
        return self

    def _run(self) -> None:
        pause = FIRST_PAUSE_S
        while not self.closed.is_set():
            try:
                for frame in self.connect():
                    pause = FIRST_PAUSE_S
                    if isinstance(frame, str):
                        self.held.put(frame)
                    if self.closed.is_set():
                        return
            except OSError:
                pass
            self.sleep(pause)
            pause = min(2 * pause, LONGEST_PAUSE_S)

    def batch(self) -> list[dict]:
        """Rows ``{"data": text}``: as many as a batch takes, or what came within the window."""
        out, end = [], time.monotonic() + self.window_s
        while len(out) < self.frames and (left := end - time.monotonic()) > 0:
            try:
                out.append({"data": self.held.get(timeout=left)})
            except queue.Empty:
                break
        return out


class SocketLines(DataSource):
    """``spark.readStream.format("tm_socket")``: text lines of a TCP connection to host and port, as rows of ``data``."""

    @classmethod
    def name(cls) -> str:
        return "tm_socket"

    def schema(self) -> str:
        return "data string"

    def simpleStreamReader(self, schema):
        return _LineReader(self.options)


class _LineReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.host, self.port, self.frames = options.get("host", "127.0.0.1"), int(options["port"]), int(options.get("frames", FRAMES))
        self.window_s, self.kept, self.next, self.source = float(options.get("window_ms", 1000)) / 1000, {}, 0, None

    def _lines(self) -> Iterator[str]:
        import socket

        with socket.create_connection((self.host, self.port), timeout=60) as s, s.makefile("r", encoding="utf-8") as lines:
            for line in lines:
                yield line.rstrip("\n")

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict):
        if self.source is None:
            self.source = Frames(self._lines, self.frames, self.window_s).start()
        for row in self.source.batch():
            self.kept[self.next] = (row["data"],)
            self.next += 1
        return iter([self.kept[i] for i in range(start["at"], self.next)]), {"at": self.next}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([self.kept[i] for i in range(start["at"], end["at"]) if i in self.kept])

    def commit(self, end: dict) -> None:
        for i in [i for i in self.kept if i < end["at"]]:
            del self.kept[i]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SocketLines)
