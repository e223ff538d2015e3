"""Secret scans with one combined automaton for all rules.

Each rule has a trigger, its shortest beginning that is worth a look, and a full pattern. The triggers of all rules make
one minimal automaton (few of them count, so it stays small); every byte of every text is read once. Where a trigger ends, the rule's reversed automaton finds
the leftmost start after the rule's last match, and the rule's own automaton the longest end. Matches of a kind don't
overlap; those that fail the rule's length are passed over as a whole.

Defined results: a null text counts as empty; every row in gives a row out, whatever its id; other columns play no part.
Offsets count code points, ends exclusive. Memory is bounded by a block of text or one document.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, parse, reverse
from .common import blocks, texts


class Rule(NamedTuple):
    kind: str
    trigger: str
    full: str
    least: int  # characters, from ``back`` characters before the trigger's end if that is set
    back: int = 0


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


VALUE = "[A-Za-z0-9+/_.=-]"
NAMES = "|".join(map(any_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = f"({NAMES})[\"']?\\x20*[:=]\\x20*[\"']?{VALUE}"
HEAD, TAIL = (f"-----{w} [A-Z ]*PRIVATE KEY-----" for w in ("BEGIN", "END"))
#: The key as far as its END line, in which no two dashes meet; or, without that line, its lines of base64.
KEY = f"((-?[^-])*{TAIL}|(\\x0D?\\x0A[A-Za-z0-9+/=]{{16,}})*(\\x0D?\\x0A[A-Za-z0-9+/]{{1,15}}==?)?)"
BASE = (
    Rule("assign", ASSIGN, f"{ASSIGN}{VALUE}*", 6, 1),
    Rule("access", "AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24}", "[0-9a-f]+", 24),
)
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("stripe", "[sr]k_(live|test)_[A-Za-z0-9]", "[sr]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 20),
    Rule("pem", HEAD, f"{HEAD}{KEY}", 20),
)
RULES = BASE + MORE


@functools.lru_cache(4)
def compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, list[Automaton], list[Automaton]]:
    triggers = [parse(r.trigger) for r in rules]
    return Automaton(triggers, anywhere=True), [Automaton([reverse(t)], anywhere=False) for t in triggers], [Automaton([parse(r.full)], anywhere=False) for r in rules]


def find(documents: list[bytes], rules: tuple[Rule, ...] = RULES) -> dict[int, list[tuple[int, int, int]]]:
    """Spans (start, rule, end) in bytes, by document; documents without any are left out."""
    every, back, full = compiled(rules)
    stream = np.frombuffer(b"\xff".join(documents), np.uint8)  # no text in UTF-8 holds this byte, and no rule
    place, state = every.scan(stream)
    if not len(place):
        return {}
    start = np.cumsum([0, *(len(d) + 1 for d in documents)])
    owner = np.searchsorted(start, place, side="right") - 1
    out: dict[int, list] = {}
    passed: dict[tuple[int, int], int] = {}
    for doc, at, s in zip(owner.tolist(), (place - start[owner] + 1).tolist(), every.accepts[state].tolist(), strict=True):
        data = documents[doc]
        for r, rule in enumerate(rules):
            low = passed.get((doc, r), 0)
            if not s >> r & 1 or at <= low:
                continue
            n = back[r].last(data, range(at - 1, low - 1, -1))
            if n < 0:
                continue
            begin = at - n
            end = begin + full[r].last(data, range(begin, len(data)))
            passed[doc, r] = end
            if end - (at - rule.back if rule.back else begin) >= rule.least:
                out.setdefault(doc, []).append((begin, r, end))
    return {doc: sorted(spans) for doc, spans in out.items()}


def in_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points."""
    ends = sorted({x for a, _, b in spans for x in (a, b)})
    points, total, last = {}, 0, 0
    for x in ends:
        total += len(data[last:x].decode("utf-8"))
        points[x], last = total, x
    return [(points[a], r, points[b]) for a, r, b in spans]


def as_bytes(text: pa.Array) -> list[bytes]:
    return text.cast(pa.large_binary()).to_pylist()


def written(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[r].kind}:{a}:{b}" for a, r, b in spans)


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """doc_id, a count for each of the first ``base`` rules, the digest of their spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in blocks(batches):
            data = as_bytes(texts(batch))
            counts = np.zeros((base, len(data)), np.int64)
            digest, spans = [nothing] * len(data), [""] * len(data)
            for doc, own in find(data, rules).items():
                own = in_points(data[doc], own)
                first = [x for x in own if x[1] < base]
                for _, r, _ in first:
                    counts[r, doc] += 1
                digest[doc], spans[doc] = hashlib.sha256(written(first, rules).encode()).hexdigest(), written(own, rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{r.kind}" for r in rules[:base]), "base_sha256", "spans"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + "".join(f"n_{r.kind} long, " for r in rules[:base]) + "base_sha256 string, spans string")


def redact(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns; each secret in text gives way to ``[kind]``, and n_chars follows. Null texts stay null."""
    names = df.columns
    own, size_of = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    # numbered, since Arrow functions look columns up by name, where a dot has a meaning
    df = df.select([F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, f"_{own}"):
            data = as_bytes(texts(batch, f"_{own}"))
            found = find(data, rules)
            if found:
                text = batch.column(own).to_pylist()
                for doc, spans in found.items():
                    parts, last = [], 0
                    for a, r, b in spans:
                        if a >= last:
                            parts += [data[doc][last:a], f"[{rules[r].kind}]".encode()]
                        last = max(last, b)
                    text[doc] = b"".join([*parts, data[doc][last:]]).decode("utf-8")
                columns = list(batch.columns)
                columns[own] = pa.array(text, columns[own].type)
                if size_of is not None:
                    size = columns[size_of].to_pylist()
                    for doc in found:
                        size[doc] = len(text[doc])
                    columns[size_of] = pa.array(size, columns[size_of].type)
                batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield batch

    return df.mapInArrow(run, df.schema).toDF(*names)
