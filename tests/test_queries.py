"""Every query beside the optional ones against DuckDB's statement, or at least run."""

import os

import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.functions import models
from tidemark.operators import joins
from tidemark.plans import engine, relational
from tidemark.session import BATCH, BATCH_BYTES

OWN = {**relational.QUERIES, **engine.QUERIES}
SAID = {**relational.ORACLES, **engine.ORACLES}


@pytest.fixture(scope="module")
def db(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, db, sf, name):
    if name in SAID:
        assert oracle.differs(spark, db, sf, OWN[name], SAID[name]) == ""
    else:
        assert OWN[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["kind", "n", "total"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.isdir(__spark_entry__.HERE)


def test_pairs_are_dealt_out(spark, tmp_path, monkeypatch):
    """The pairs of a table of one file come from several tasks; the nearest row is that of all blocks, nulls last."""
    base = [(i, [float(i % 5), None if i == 7 else 1.0], i // 30) for i in range(90)] + [(100, None, 0), (120, [1.0, 1.0], 9), (140, [3.0, float("nan")], 1), (160, None, 2), (180, [2.0, 1.0], None)]
    spark.createDataFrame(base, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.range(200).selectExpr("id as s_suppkey", "CASE WHEN id < 190 THEN id * 60.0D - 999 END as s_acctbal").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    db = oracle.duckdb.connect()
    for t in ("embeddings", "supplier"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    pairs = OWN["join_theta"](spark, str(tmp_path))
    assert oracle.differs(spark, db, str(tmp_path), OWN["join_theta"], SAID["join_theta"]) == "" and pairs.count() > 0
    assert pairs.select(F.spark_partition_id()).distinct().count() > 1
    monkeypatch.setattr(joins, "ROWS_A_BLOCK", 20)
    monkeypatch.setattr(joins, "QUERIES_A_BLOCK", 3)
    rows = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    got = joins.nearest_join(rows.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as q", "label"), rows)
    assert sorted((r.query_id, r.vec_id, r.d) for r in got.collect() if r.query_id < 160 and r.query_id not in (100, 140)) == [(0, 5, 0.0), (20, 0, 0.0), (40, 30, 0.0), (60, 65, 0.0), (80, 60, 0.0)]
    assert {r.query_id: (r.vec_id, r.d) for r in got.collect() if r.query_id in (100, 120, 160)} == {100: (0, None), 160: (60, None)}


def test_model_batches_are_bounded(spark):
    """Long texts reach a model in batches of bounded bytes, and a worker's cache doesn't hold them."""

    class Counted:
        def embed(self, texts):
            return [[float(len(texts))] for _ in texts]

    kept = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "64m")
    try:
        texts = spark.range(0, 600, 1, 1).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 23_000)).alias("t"))
        assert texts.select(models.embed_function(Counted())("t")[0].alias("n")).agg(F.max("n")).first()[0] * 23_000 < 1.2 * BATCH_BYTES
    finally:
        spark.conf.set(BATCH, kept)
    assert len(models.digest("x" * 24_000)) == 16


def test_plans(spark, sf):
    """Filters and columns reach the scan, and a rank limit stays above the choice of the newest row."""
    plan = relational.QUERIES["filter_numeric"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,250000.0)" in plan and "o_orderpriority" not in plan.partition("ReadSchema")[2]
    newest = engine.QUERIES["keyed_newest_wins"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in newest
