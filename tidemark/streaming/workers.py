"""Workers: user code over batches of rows, with side outputs, calls and alarms.

A worker is a Python callable ``(rows, ctx) -> rows``, or an object with ``batch``, ``fetch`` or ``alarm``. Rows are dicts.
Its effects are only taken if the turn ends well. Isolation is that of a thread with a deadline, not a sandbox.
"""

from __future__ import annotations

import os
import re
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlparse

from ..errors import Refused

SECONDS = 15.0


class Overtime(RuntimeError):
    """The turn took longer than it may."""


@dataclass
class Context:
    """What a worker may do beside returning rows."""

    source: str | None = None
    now_ms: int = 0
    hosts: tuple[str, ...] = ()
    transport: Callable | None = None
    missed: int = 0
    outputs: dict[str, list[dict]] = field(default_factory=dict)
    alarm_set: bool = False
    alarm_ms: int | None = None

    def write(self, stream: str, rows: list[dict]) -> None:
        """Rows for another table, landed before the cursor moves."""
        if stream == self.source:
            raise Refused("a worker doesn't write to its own source")
        checked_rows(rows)
        self.outputs.setdefault(stream, []).extend(rows)

    def call(self, url: str, **request):
        """An HTTP request to an allowed host or a subdomain of one; ``{{env:NAME}}`` stands for a secret of the host's environment."""
        if self.transport is None:
            raise Refused("calls are not set up")
        fill = lambda v: re.sub(r"\{\{env:([A-Za-z0-9_]+)\}\}", lambda m: os.environ.get(m[1], ""), v) if isinstance(v, str) else {k: fill(x) for k, x in v.items()} if isinstance(v, dict) else v
        at = urlparse(url)
        host = (at.hostname or "").lower()
        if at.scheme not in ("http", "https") or not any(host == h or host.endswith("." + h) for h in self.hosts):
            raise Refused(f"calls to {host or url!r} are not allowed")
        return self.transport(fill(url), **{k: fill(v) for k, v in request.items()})

    def set_alarm(self, at_ms: int) -> None:
        self.alarm_set, self.alarm_ms = True, at_ms

    def get_alarm(self) -> int | None:
        return self.alarm_ms

    def delete_alarm(self) -> None:
        self.alarm_set, self.alarm_ms = True, None


def checked_rows(rows) -> list[dict]:
    if not isinstance(rows, list):
        raise Refused(f"a worker returns a list of rows, not {type(rows).__name__}")
    for i, r in enumerate(rows):
        if not isinstance(r, dict):
            raise Refused(f"row {i} is not an object")
    return rows


def timed(call: Callable, seconds: float):
    """The call's result, or an error after so long."""
    out: dict = {}

    def run():
        try:
            out["value"] = call()
        except BaseException as e:  # noqa: BLE001  it goes to the caller
            out["error"] = e

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        raise Overtime(f"the turn took more than {seconds} s")
    if "error" in out:
        raise out["error"]
    return out["value"]


def turn(worker, rows: list[dict], ctx: Context, entry: str = "batch", seconds: float = SECONDS) -> list[dict]:
    """One turn. Nothing may be returned only by a turn that wrote or set an alarm."""
    handler = getattr(worker, entry, None) or (worker if entry == "batch" and callable(worker) else None)
    if handler is None:
        raise Refused(f"the worker has no {entry}")
    made = timed(lambda: handler(rows, ctx), seconds)
    if made is None:
        if not (ctx.outputs or ctx.alarm_set):
            raise Refused("the worker returned nothing, wrote nothing and set no alarm")
        return []
    return checked_rows(made)
