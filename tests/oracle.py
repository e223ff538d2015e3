"""Compares a query's rows with those of DuckDB."""

import decimal
import math

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'; SET threads = 4")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return db


def plain(x):
    if isinstance(x, decimal.Decimal):
        return str(x.normalize())
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    if isinstance(x, list | tuple):
        return [plain(v) for v in x]
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([plain(r[i]) for i in order] for r in data), key=str)


def differs(spark, db, sf, query, sql):
    """Empty, or how the two differ."""
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(sql)
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return f"{len(bad)} of {len(got[1])} rows: {bad[0]}" if bad else ""
