import random

import numpy as np
import pytest

from tidemark.llm import quality, queries


def test_held_out_accuracy(spark):
    """Fitted on half of the labelled rows, it keeps clean documents of the other half and drops junk."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = labels.where("pmod(xxhash64(doc_id, 1), 2) = 0")
    kept = {r.doc_id: r.kept for r in quality.classify(docs, half).collect()}
    rest = [r for r in labels.collect() if r.doc_id not in {x.doc_id for x in half.collect()}]
    good = [kept[r.doc_id] for r in rest if r.quality == 1 and r.toxic == 0]
    junk = [kept[r.doc_id] for r in rest if r.quality == 0]
    assert np.mean(good) >= 0.98 and np.mean(junk) <= 0.1, (np.mean(good), np.mean(junk))


def test_weights_match_a_plain_version(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    targets = quality.target_ids(labels)
    ratio = quality.fit(docs, targets)
    import pyarrow as pa

    rows = {r.doc_id: r.text for r in docs.collect()}
    raw, good = np.ones(quality.FEATURES), np.ones(quality.FEATURES)
    own = {i: quality.features(pa.array([t], pa.large_string()))[0] for i, t in rows.items()}
    for i, f in own.items():
        np.add.at(raw, f, 1)
        if i in targets:
            np.add.at(good, f, 1)
    want = np.log(good / good.sum()) - np.log(raw / raw.sum())
    assert ratio == pytest.approx(want)
    got = queries.QUERIES["op9_quality"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_grams == len(own[r.doc_id]) and r.log_ratio == pytest.approx(want[own[r.doc_id]].sum(), abs=1e-6)


def test_kth_largest(spark):
    rng = random.Random(4)
    values = [rng.choice([rng.random(), 0.25, 1e6]) for _ in range(9000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 3000, 3001, 6500, 9000):
        assert quality.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_edge_rows(spark):
    rows = [(1, None, 1.0, 1), (None, "", 1.0, 1), (2, "a b c", 1.0, 2), (2, "a b c", 1.0, 2), (3, "x " * 300000, 0.0, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, weight double, key int")
    labels = spark.createDataFrame([(2, 1, 0), (2, 1, 0), (None, 1, 0), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    assert len(got) == 5 and all(r.kept for r in got if r.doc_id == 2) and not any(r.kept for r in got if r.doc_id == 3)
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and 3 not in {r.doc_id for r in kept.collect()}
    assert quality.classify(df, labels.limit(0)).where("kept").count() == 5
    assert quality.classify(df.limit(0), labels).count() == 0


def test_held_out_toxic(spark):
    """Fitted on half of the labelled rows, it drops toxic documents of the other half, fluent ones too, and keeps clean ones."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = labels.where("pmod(xxhash64(doc_id, 1), 2) = 0")
    kept = {r.doc_id: r.kept for r in quality.classify(docs, half).collect()}
    rest = [r for r in labels.collect() if r.doc_id not in {x.doc_id for x in half.collect()}]
    toxic = [kept[r.doc_id] for r in rest if r.quality == 1 and r.toxic == 1]
    good = [kept[r.doc_id] for r in rest if r.quality == 1 and r.toxic == 0]
    junk = [kept[r.doc_id] for r in rest if r.quality == 0]
    print(f"kept of held-out: toxic {np.mean(toxic):.4f} of {len(toxic)}, clean {np.mean(good):.4f} of {len(good)}, junk {np.mean(junk):.4f} of {len(junk)}")
    assert np.mean(toxic) <= 0.1 and np.mean(good) >= 0.98 and np.mean(junk) <= 0.1
