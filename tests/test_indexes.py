"""Postings and vector cells: what they hold, that newer rows count, and that searches read only their part."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.search import search
from tidemark.sources import indexes
from tidemark.sources.tables import Catalog


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "root"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def bm25(texts, query):
    split = {i: [w for w in re.split(r"[^\w]+", (t or "").lower()) if w] for i, t in texts.items()}
    mean, out = sum(map(len, split.values())) / len(split), {}
    for term in set(query.split()):
        tfs = {i: Counter(w)[term] for i, w in split.items() if term in w}
        for i, tf in tfs.items():
            weight = math.log(1 + (len(split) - len(tfs) + 0.5) / (len(tfs) + 0.5))
            out[i] = out.get(i, 0) + weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(split[i]) / mean))
    return out


@pytest.mark.parametrize("keys", [["id"], None])
def test_text_of_several_generations(spark, catalog, keys):
    first = {1: "Blue kite, blue lake", 2: None, 3: "", 4: "kite over a pond", 5: "lake"}
    later = {5: "kite kite kite", 6: "a lake, a pond and a blue heron"}
    schema = "id long, term string"  # a column named as an index might name its own
    table = catalog.create("notes", spark.createDataFrame(list(first.items()), schema), keys)
    table.index_text("term")
    catalog.table("notes").append(spark.createDataFrame(list(later.items()), schema))
    now = [first | later] if keys else None
    for step in ("two generations", "one"):
        got = {(r.id, r.term): r._score for r in search(catalog.table("notes"), {"full_text": "blue kite"}).collect()}
        if keys:
            want = bm25(now[0], "blue kite")
            assert {i: pytest.approx(s) for i, s in want.items()} == {i: s for (i, _), s in got.items()}, step
        else:
            assert {i for i, _ in got} == {1, 4, 5, 6}, step
        assert [r.id for r in search(catalog.table("notes"), {"full_text": "pond", "filter": "id < 6"}).collect()] == [4]
        assert search(catalog.table("notes"), {"full_text": "?!"}).count() == 0
        if step == "two generations":
            catalog.table("notes").compact()
    assert catalog.table("notes").vacuum(0) >= 4
    assert search(catalog.table("notes"), {"full_text": "heron"}).count() == 1
    read = plan(catalog.table("notes").postings("term", catalog.table("notes").manifest()).where("_tm_term in ('pond', 'lake')"))
    assert "In(_tm_term, [lake,pond])" in read


def test_index_of_an_empty_table(spark, catalog):
    table = catalog.create("e", spark.createDataFrame([], "id long, note string, v array<float>"), ["id"], widths={"v": 2})
    table.index_text("note")
    table.index_vector("v", "l2", cells=4)
    assert search(table, {"full_text": "x"}).count() == 0 and search(table, {"vector": [0, 1]}).count() == 0
    table = catalog.table("e")
    table.append(spark.createDataFrame([(1, "x y", [0.0, 1.0]), (2, None, None)], "id long, note string, v array<float>"))
    assert [r.id for r in search(table, {"full_text": "x"}).collect()] == [1]
    assert [r.id for r in search(table, {"vector": [0, 1]}).collect()] == [1]


def clustered(n=1500, width=8):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, width)) * 6
    return (centres[rng.integers(0, 30, n)] + rng.normal(size=(n, width))).astype(np.float32)


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_cells(spark, catalog, metric):
    x = clustered()
    rows = [(i, i % 7, v.tolist()) for i, v in enumerate(x)]
    schema = "id long, part int, v array<float>"
    table = catalog.create("vs", spark.createDataFrame(rows, schema), ["id"], widths={"v": 8})
    table.index_vector("v", metric, cells=32)
    table.append(spark.createDataFrame([(5, 0, rows[9][2]), (2000, 1, None)], schema))  # one row is superseded, one has no vector
    x[5] = x[9]
    table = catalog.table("vs")
    assert table.indexes() == [{"column": "v", "kind": "vector", "metric": metric, "cells": True}]
    exact = {"l2": lambda q: ((x - q) ** 2).sum(1), "cosine": lambda q: 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q), "dot": lambda q: 1 - x @ q}[metric]
    hits = 0
    for q in (0, 9, 77, 400, 901):
        want = [int(i) for i in np.lexsort((np.arange(len(x)), exact(x[q].astype(float))))[:10]]
        ids = lambda n, **more: [r.id for r in search(table, {"vector": x[q].tolist(), "nprobes": n, **more}).collect()]  # noqa: B023, E731
        assert set(ids(32)) == set(want)
        hits += len(set(ids(6)) & set(want))
    assert hits >= 45
    only = search(table, {"vector": x[0].tolist(), "nprobes": 1, "filter": "part = 3", "k": 150}).collect()
    assert len(only) == 150 and {r.part for r in only} == {3}  # more cells are read where those nearest hold too few
    read, whole = table.probe("v", x[0].tolist(), 3, table.manifest())
    assert not whole and read.count() < len(x) / 2 and "PushedFilters: [In(_tm_cell" in plan(read)


def test_another_metric_rewrites_cells(spark, catalog):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(200))]
    table = catalog.create("vs", spark.createDataFrame(rows, "id long, v array<float>"), ["id"], widths={"v": 8})
    table.index_vector("v", "l2", cells=4)
    before = table.manifest()
    table.index_vector("v", "cosine")
    after = catalog.table("vs").manifest()
    assert after["version"] == before["version"] and after["centres"]["v"]["name"] != before["centres"]["v"]["name"]
    assert all(g["cells"]["v"]["of"] == after["centres"]["v"]["name"] for g in after["generations"])
    assert search(catalog.table("vs"), {"vector": rows[3][1], "k": 1}).first().id == 3
    assert table.vacuum(0) == 1


def test_words_are_counted_once(spark, catalog, monkeypatch):
    """An index's ranges look at its postings more than once, and the words of a text are counted before that."""
    seen, words = spark.sparkContext.accumulator(0), indexes.words

    def noted(text):
        seen.add(1)
        return text

    monkeypatch.setattr(indexes, "words", lambda c: words(F.udf(noted, "string").asNondeterministic()(c)))
    table = catalog.create("t", spark.range(40).select("id", F.concat(F.lit("one two one w"), F.col("id").cast("string")).alias("text")), ["id"])
    table.index_text("text")
    assert seen.value == 40
    assert search(catalog.table("t"), {"full_text": "w7 w9", "columns": ["id"]}).count() == 2
