"""What a Python worker needs beside the batch that it was given."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from tidemark.llm import bpe, quality, queries


class Given(Exception):
    """Carries the function that a worker would run."""


class Frame:
    """Stands for a DataFrame whose one stage is that function."""

    columns, dtypes = ["doc_id", "text"], [("doc_id", "bigint"), ("text", "string")]
    schema = {"doc_id": type("", (), {"dataType": type("", (), {"simpleString": staticmethod(lambda: "bigint")})})}

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        raise Given(run)


def needed(run) -> float:
    """MB that numpy, Python and Arrow hold at most for a batch of 4 MB."""
    rng = random.Random(3)
    known = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(5000)]
    text = [" ".join(rng.choices(known, k=300)) for _ in range(2200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(text))), pa.array(text)], ["doc_id", "text"])
    assert 4e6 < batch.nbytes < 6e6
    list(run(iter([batch.slice(0, 5)])))  # what is kept for good
    usual, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        return (tracemalloc.get_traced_memory()[1] + pool.max_memory()) / 1e6
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(usual)


@pytest.mark.parametrize("made", [lambda: quality.fit(Frame(), {1, 2}), lambda: bpe.encode(Frame(), queries.tokenizer_path())], ids=["quality", "encoding"])
def test_a_worker_needs_little_for_a_batch(made):
    with pytest.raises(Given) as given:
        made()
    got = needed(given.value.args[0])
    print(f"{got:.1f} MB")
    assert got < 40


def test_sampled_ids_need_no_workers(spark, sf, monkeypatch):
    """Rows from a list would be pickled again by a second set of Python workers."""
    frames, kind = [], type(spark)
    own = kind.createDataFrame
    monkeypatch.setattr(kind, "createDataFrame", lambda *a, **b: frames.append(own(*a, **b)) or frames[-1])
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    good, toxic = quality.target_ids(labels), quality.sample_ids(labels, "toxic = 1")
    word, ratio = quality.toxic_words(docs, good, toxic)
    assert len(word) == len(ratio) and frames
    assert {tuple(r) for f in frames for r in f.collect()} == {(i, i in toxic) for i in good | toxic}
    assert not any("PythonRDD" in f._jdf.queryExecution().toRdd().toDebugString() for f in frames)
