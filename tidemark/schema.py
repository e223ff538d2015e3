"""Column kinds, declared schemas, and the two hidden columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import Refused

KEY, SEQ = "_tm_key", "_tm_seq"
HIDDEN = (KEY, SEQ)
NAME = re.compile(r"[A-Za-z0-9_-]+")
KINDS: dict[str, T.DataType] = {
    "string": T.StringType(), "json": T.StringType(), "int64": T.LongType(), "float64": T.DoubleType(), "boolean": T.BooleanType(), "decimal": T.DecimalType(38, 9), "timestamp": T.TimestampType(),
}
METRICS = ("l2", "cosine", "dot")


def check_name(name: str) -> str:
    if not isinstance(name, str) or not NAME.fullmatch(name):
        raise Refused(f"a name has letters, digits, _ and - only: {name!r}")
    return name


def data_type(kind: str) -> T.DataType:
    """Spark's type for a declared kind; ``vector:N`` is an array of floats."""
    if m := re.fullmatch(r"vector:([0-9]+)", kind):
        if int(m[1]) < 1:
            raise Refused("a vector has at least one component")
        return T.ArrayType(T.FloatType())
    if kind not in KINDS:
        raise Refused(f"unknown kind {kind!r}")
    return KINDS[kind]


@dataclass
class Column:
    name: str
    kind: str
    nullable: bool = True

    @property
    def width(self) -> int | None:
        return int(self.kind.partition(":")[2]) if self.kind.startswith("vector:") else None


@dataclass
class Definition:
    """What the catalog holds of a table. Without a primary key, all user columns together identify a row."""

    name: str
    columns: list[Column]
    primary_key: list[str] = field(default_factory=list)
    vector_indexes: dict[str, str] = field(default_factory=dict)
    text_indexes: list[str] = field(default_factory=list)
    ddl: str | None = None  # of tables made from data, whose types may be any of Spark's

    def __post_init__(self):
        check_name(self.name)
        names = [c.name for c in self.columns]
        if not names or len(set(names)) != len(names):
            raise Refused("columns must be there and have different names")
        if odd := [n for n in names if n.startswith("_")]:
            raise Refused(f"names that begin with _ are reserved: {odd}")
        if unknown := [k for k in [*self.primary_key, *self.vector_indexes, *self.text_indexes] if k not in names]:
            raise Refused(f"no such column: {unknown}")
        if any(m not in METRICS for m in self.vector_indexes.values()):
            raise Refused(f"a metric is one of {METRICS}")
        for c in self.columns:
            if self.ddl is None:
                data_type(c.kind)
            if c.name in self.primary_key:
                c.nullable = False
            if c.width and c.name not in self.vector_indexes:
                self.vector_indexes[c.name] = "l2"

    @property
    def schema(self) -> T.StructType:
        if self.ddl is not None:
            plain = T.StructType.fromDDL(self.ddl)
            return T.StructType([T.StructField(f.name, f.dataType, f.name not in self.primary_key) for f in plain])
        return T.StructType([T.StructField(c.name, data_type(c.kind), c.nullable) for c in self.columns])

    def shape(self) -> tuple:
        """What must agree for exist_ok; indexes don't count."""
        return (self.schema.simpleString(), tuple((c.name, c.width, c.nullable) for c in self.columns), tuple(self.primary_key))

    def to_dict(self) -> dict:
        return {
            "name": self.name, "columns": [{"name": c.name, "kind": c.kind, "nullable": c.nullable} for c in self.columns], "primary_key": self.primary_key,
            "vector_indexes": self.vector_indexes, "text_indexes": self.text_indexes, "ddl": self.ddl,
        }

    @classmethod
    def from_dict(cls, data: dict, strict: bool = True) -> Definition:
        """strict: a request, in which unknown fields are refused; else a stored form, which may come from a later version."""
        known = {"name", "columns", "primary_key", "vector_indexes", "text_indexes", "ddl"}
        if strict and (odd := set(data) - known):
            raise Refused(f"unknown fields {sorted(odd)}")
        fields = {"name", "kind", "nullable"}
        if strict and (odd := {k for c in data.get("columns", []) for k in c} - fields):
            raise Refused(f"unknown fields {sorted(odd)}")
        columns = [Column(**{k: v for k, v in c.items() if k in fields}) for c in data.get("columns", [])]
        return cls(columns=columns, **{k: v for k, v in data.items() if k in known - {"columns"}})

    @classmethod
    def of(cls, name: str, schema: T.StructType, primary_key: list[str] | None = None, widths: dict[str, int] | None = None) -> Definition:
        """For data of any Spark types; widths: of its vector columns."""
        widths = widths or {}
        columns = [Column(f.name, f"vector:{widths[f.name]}" if f.name in widths else f.dataType.simpleString(), f.nullable) for f in schema if f.name not in HIDDEN]
        if maps := [f.name for f in schema if isinstance(f.dataType, T.MapType | T.VariantType)]:
            if not primary_key:
                raise Refused(f"rows can't be told apart by columns of this type: {maps}")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name not in HIDDEN)
        return cls(name, columns, list(primary_key or []), ddl=ddl)


def visible(df: DataFrame) -> DataFrame:
    """Without the hidden columns."""
    return df.drop(*HIDDEN)


def conform(df: DataFrame, definition: Definition) -> DataFrame:
    """The same rows, if names, order and types are the table's; nulls in required columns and wrong widths fail the job."""
    want = definition.schema
    if [(f.name, f.dataType.simpleString()) for f in df.schema] != [(f.name, f.dataType.simpleString()) for f in want]:
        raise Refused(f"{definition.name} has {want.simpleString()}, not {df.schema.simpleString()}")
    out = []
    for c in definition.columns:
        value = F.col(f"`{c.name}`")
        if not c.nullable:
            value = F.when(value.isNull(), F.raise_error(F.lit(f"{c.name} is null"))).otherwise(value)
        if c.width:
            value = F.when(F.size(value) != c.width, F.raise_error(F.lit(f"{c.name} has not {c.width} components"))).otherwise(value)
        out.append(value.alias(c.name))
    return df.select(*out)


def identity(definition: Definition) -> list[str]:
    """Columns that tell rows apart."""
    return definition.primary_key or [KEY]


def content_key(definition: Definition):
    """A hash of all user columns in which null, empty and missing differ."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c.name}`") for c in definition.columns]), {"ignoreNullFields": "false"}), 256)
