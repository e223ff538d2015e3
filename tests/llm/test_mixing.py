import duckdb
import pytest

from tidemark.llm import mixing, queries


def by_oracle(path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    return con.execute(mixing.SQL).fetchall()


def same(got, want):
    key = lambda r: tuple(str(x) for x in r[:5]) + tuple(f"{x:.6f}" if x is not None else "" for x in r[5:])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b), (a, b)


def test_query(spark, sf):
    got = queries.QUERIES["op10_mixing"](spark, sf).collect()
    same(got, by_oracle(f"{sf}/documents.parquet"))
    by_source = {}
    for r in got:
        by_source.setdefault((r.source_size, r.target), []).append(r)
    total = sum(r.size for r in got)
    assert sum(t for _, t in by_source) == pytest.approx(1.5 * total)
    for (size, target), rows in by_source.items():
        assert target <= 2 * size and abs(sum(r.taken for r in rows) - target) <= 1
        assert all(0 <= r.taken <= 2 * r.size for r in rows)
    where = [r.position for r in got if r.position is not None]
    assert where == sorted(where)


def test_edge_rows(spark, tmp_path):
    rows = [(1, "a b c", None, 5), (2, None, "s", 5), (3, "", "s", 5), (None, "x y", "t", 5), (4, "p q", "t", 5), (4, "p q", "t", 5), (5, "w " * 50000, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    same(mixing.plan(df).collect(), by_oracle(f"{tmp_path}/d/*.parquet"))
    assert mixing.plan(df.limit(0)).count() == 0
    assert mixing.mixed(df).columns == df.columns
    assert {r.doc_id for r in mixing.mixed(df).collect()} == {1, None, 4, 5}
