"""JSON values as they arrived, and their exact conversion to column kinds, as Spark expressions.

A literal is a struct of kind (null, bool, number, text, object, array), text (its characters, a string's without quotes)
and json (as it would go round trip). Numbers stay text, so no digit is lost. Conversions give null where a value doesn't
fit; they never round.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from json.decoder import JSONDecodeError, JSONDecoder, scanstring

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds from the most specific on, with Spark's types. Fixed order.
KINDS: dict[str, T.DataType] = {
    "boolean": T.BooleanType(), "int64": T.LongType(), "float64": T.DoubleType(), "decimal": T.DecimalType(38, 9), "timestamp_text": T.TimestampType(), "timestamp_seconds": T.TimestampType(),
    "timestamp_millis": T.TimestampType(), "timestamp_micros": T.TimestampType(), "string": T.StringType(), "json": T.StringType(),
}
STORED = {"timestamp_text": "timestamp", "timestamp_seconds": "timestamp", "timestamp_millis": "timestamp", "timestamp_micros": "timestamp"}
KEYABLE = ("int64", "string", "boolean")
LOSSLESS = ("boolean", "int64", "decimal", "string", "json")
LITERAL = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "text", "json", "name")])
FIELDS = T.MapType(T.StringType(), LITERAL)
YEAR_2000, YEAR_2100 = 946_684_800_000_000, 4_102_444_800_000_000

_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_SPACE = re.compile(r"[ \t\n\r]*")
#: A field whose name has no escapes and whose value isn't nested, up to the comma or bracket after it: all of it, name, string, other value, end.
_STRING = r'"[^"\\\x00-\x1f]*(?:\\.[^"\\\x00-\x1f]*)*"'
_FIELD = re.compile(rf'([ \t\n\r]*"([^"\\\x00-\x1f]*)"[ \t\n\r]*:[ \t\n\r]*(?:({_STRING})|({_NUMBER.pattern}|true|false|null))[ \t\n\r]*([,}}]))')
_OPEN = re.compile(r"[ \t\n\r]*\{")
_DECODER = JSONDecoder()


def value_end(text: str, at: int) -> int:
    """Where the JSON value that starts at a place ends; errors if there is none."""
    if text[at : at + 1] == '"':
        return scanstring(text, at + 1)[1]
    if m := _NUMBER.match(text, at):
        return m.end()
    return _DECODER.raw_decode(text, at)[1]


def literal(raw: str) -> tuple[str, str, str]:
    """kind, text and json of one value's characters."""
    first = raw[:1]
    if first == '"':
        text = json.loads(raw)
        return "text", text, json.dumps(text, ensure_ascii=False)
    kind = {"n": "null", "t": "bool", "f": "bool", "{": "object", "[": "array"}.get(first, "number")
    return kind, raw, raw


def read_object(text: str) -> dict[str, tuple[str, str, str]] | None:
    """Fields of a record with their literals, or None if it is no JSON object. Of repeated names the last counts."""
    skip = lambda i: _SPACE.match(text, i).end()
    try:
        at = skip(0)
        if text[at : at + 1] != "{":
            return None
        out, at = {}, skip(at + 1)
        while text[at : at + 1] != "}":
            if text[at : at + 1] != '"':
                return None
            name, at = scanstring(text, at + 1)
            at = skip(at)
            if text[at : at + 1] != ":":
                return None
            start = skip(at + 1)
            at = value_end(text, start)
            out[name] = literal(text[start:at])
            at = skip(at)
            if text[at : at + 1] == ",":
                at = skip(at + 1)
                if text[at : at + 1] == "}":
                    return None
            elif text[at : at + 1] != "}":
                return None
        return out if skip(at + 1) == len(text) else None
    except (JSONDecodeError, ValueError, RecursionError, StopIteration):
        return None


def read_flat(text: str) -> dict[str, tuple[str, str, str]] | None:
    """The same as ``read_object`` in one scan, for records of plain fields; None for all others, object or not."""
    start = _OPEN.match(text)
    found = _FIELD.findall(text, start.end()) if start else []
    ends = "".join([f[4] for f in found])
    # the fields are the whole text only if nothing was passed over between them
    if not found or ends != "," * (len(found) - 1) + "}" or start.end() + sum([len(f[0]) for f in found]) != len(text.rstrip(" \t\n\r")):
        return None
    out = {}
    for _, name, string, other, _ in found:
        if not string:
            out[name] = ("number" if other[0] not in "tfn" else "null" if other == "null" else "bool", other, other)
        elif "\\" in string:
            try:
                out[name] = literal(string)
            except ValueError:
                return None
        else:
            out[name] = ("text", string[1:-1], string)
    return out


def split_records(body: str) -> list[str]:
    """The records of a request's body, verbatim: an array, one record, or an object whose only field ``records`` is an array."""
    at = _SPACE.match(body).end()
    if body[at : at + 1] == "{":
        fields = read_object(body)
        if fields is None:
            raise ValueError("the body is not JSON")
        if list(fields) == ["records"] and fields["records"][0] == "array":
            body, at = fields["records"][2], 0
        else:
            return [body.strip()]
    if body[at : at + 1] != "[":
        return [body.strip()]
    out, at = [], _SPACE.match(body, at + 1).end()
    while body[at : at + 1] != "]":
        end = value_end(body, at)
        out.append(body[at:end])
        at = _SPACE.match(body, end).end()
        if body[at : at + 1] == ",":
            at = _SPACE.match(body, at + 1).end()
        elif body[at : at + 1] != "]":
            raise ValueError("the body is not JSON")
    return out


@lru_cache(4096)
def _named(name: str) -> str:
    return json.dumps(name, ensure_ascii=False)


def _fields(record: pa.Array) -> pa.Array:
    """Fields of each record's text by name; null if it is no object. Arrow batches; JSON readers of the engine lose digits."""
    names, values, starts, at = [], [], [], 0
    for text in record.to_pylist():
        read = None if text is None else read_flat(text)
        if read is None and text is not None:
            read = read_object(text)
        starts.append(None if read is None else at)
        if read:
            names += read
            values += read.values()
            at += len(read)
    columns = list(zip(*values, strict=True)) or [(), (), ()]
    made = pa.StructArray.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(map(_named, names), pa.string())], ["kind", "text", "json", "name"])
    return pa.MapArray.from_arrays(pa.array([*starts, at], pa.int32()), pa.array(names, pa.string()), made)


fields = F.arrow_udf(_fields, FIELDS)
#: The same for large frames: the optimizer would repeat the other one below each filter of what it gives.
fields_once = F.arrow_udf(_fields, FIELDS).asNondeterministic()


def _if(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def parts(value: Column) -> dict[str, Column]:
    """What several kinds ask of a literal: its integer, and whether it may be a quantity. As columns they are worked out once."""
    text, number, string = value["text"], value["kind"] == "number", value["kind"] == "text"
    plain = text.rlike(r"^-?(0|[1-9][0-9]*)$")  # a string that is an integer; no leading zero, since a code may have one
    quantity = text.rlike(r"^-?(0|[1-9][0-9]*|(0|[1-9][0-9]*)\.[0-9]+)$")
    return {"_whole": F.when(number & ~text.rlike("[.eE]") | string & plain, text.try_cast("long")), "_quantity": number | string & quantity}


def convert(kind: str, value: Column, known: dict[str, Column] | None = None) -> Column:
    """The literal as a kind, exactly or not at all. known: columns that hold its ``parts``."""
    text, string = value["text"], value["kind"] == "text"
    number = value["kind"] == "number"
    whole, quantity = (known or parts(value)).values()
    if kind == "boolean":
        return _if(value["kind"] == "bool", text == "true")
    if kind == "int64":
        return whole
    if kind == "float64":
        read = _if(quantity, text.try_cast("double"))
        return _if((F.abs(read) < float("inf")), read)
    if kind == "decimal":
        exact = text.rlike(r"^-?[0-9]{1,29}(\.[0-9]{0,9})?$")
        return _if(quantity & exact, text.try_cast("decimal(38,9)"))
    if kind == "timestamp_text":
        said = F.trim(text)
        zoned = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})?$"
        fine = said.rlike(zoned) | said.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
        return _if(string & fine, F.upper(said).try_cast("timestamp"))
    if kind.startswith("timestamp_"):
        unit = {"seconds": 1_000_000, "millis": 1_000, "micros": 1}[kind.partition("_")[2]]
        inside = whole.between(-(-YEAR_2000 // unit), (YEAR_2100 - 1) // unit)
        return _if(inside, F.timestamp_micros(whole * F.lit(unit)))
    if kind == "string":
        return _if(string | number | (value["kind"] == "bool"), text)
    return _if(value["kind"] != "null", value["json"])


def fits(kind: str, value: Column, known: dict[str, Column] | None = None) -> Column:
    return convert(kind, value, known).isNotNull()


def candidates(seen: dict) -> list[str]:
    """Kinds that all values convert to, from a profile's counts (see ``rules.profile``)."""
    if not seen["filled"]:
        return ["string"]
    if seen["nested"]:
        return ["json"]
    return [k for k in KINDS if k != "json" and seen[f"fit_{k}"] == seen["filled"]]


def lossless(options: list[str]) -> str:
    """The narrowest kind that loses nothing; floating point rounds and timestamps interpret, so they are never it."""
    return next((k for k in LOSSLESS if k in options), "json")
