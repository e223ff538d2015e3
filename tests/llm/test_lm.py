import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import lm, queries


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) + ["\n"]


def check(got, rows):
    c = Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in words(t))
    total, distinct = sum(c.values()), len(c)
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        own = words(text[r.doc_id])
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in own), abs=1e-6)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(queries.QUERIES["op2_lm"](spark, sf).collect(), rows)


def test_rare_words_and_held_out_gain(spark, monkeypatch):
    """With few frequent words the join does the rest; held-out text is more probable than under unigrams."""
    monkeypatch.setattr(lm, "FREQUENT", 300)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{(7 * k + i % 5) % 40}" if k % 2 else f"R{rng.integers(0, 900)}" for k in range(60))) for i in range(700)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_add_up_to_one():
    names = ["\n", *(f"w{i}" for i in range(lm.CLASSES + 500))]
    own = lm.Words(names, [5 + i % 9 for i in range(len(names))], sum(5 + i % 9 for i in range(len(names))), len(names))
    params = lm.initial(own)
    all_classes = np.arange(lm.CLASSES)
    for one, two in ((3, lm.BEGIN), (lm.BEGIN, lm.BEGIN), (0, 9)):
        p = lm.class_scores(params, all_classes, np.full(lm.CLASSES, one), np.full(lm.CLASSES, two))
        assert (10**p).sum() == pytest.approx(1, abs=1e-5)
    inner = np.bincount(lm.buckets(names[lm.HEAD :]), own.c[lm.HEAD :] + 1.0, minlength=lm.BUCKETS)
    assert (inner + 1) / 10**own.log_others == pytest.approx(np.ones(lm.BUCKETS))


def test_frequent_words_are_hashed_once(monkeypatch):
    """Each block looks its words up; only those that aren't among the frequent ones are hashed then."""
    names = ["\n", *(f"w{i}" for i in range(lm.CLASSES + 500))]
    own = lm.Words(names, [5] * len(names), 5 * len(names), len(names))
    flat = [*names[1:], "é", "new", "é", *names[-3:]]
    hashed = []
    monkeypatch.setattr(lm, "zlib", SimpleNamespace(crc32=lambda w: hashed.append(w) or zlib.crc32(w)))
    place, bucket = own.look_up(pa.array(flat, pa.large_string()))
    at = {w: i for i, w in enumerate(names)}
    assert place.tolist() == [at.get(w, -1) for w in flat]
    assert bucket.tolist() == [0 if 0 <= at.get(w, -1) < lm.HEAD else zlib.crc32(w.encode()) % lm.BUCKETS for w in flat]
    assert sorted(hashed) == ["new".encode(), "é".encode()]


def plain_score(texts, params, own, c):
    """Each text's score, token by token, with the softmax over all classes written out."""
    far, near, out, bias = [p.astype(float) for p in params]
    at = {w: i for i, w in enumerate(own.words.to_pylist()[: lm.HEAD])}
    rest = {}
    for w in c.keys() - at.keys():
        s, n = rest.get(zlib.crc32(w.encode()) % lm.BUCKETS, (0, 0))
        rest[zlib.crc32(w.encode()) % lm.BUCKETS] = (s + c[w], n + 1)
    for text in texts:
        back, total = [lm.BEGIN, lm.BEGIN], 0.0
        for w in words(text):
            logits = out @ (far[back[0]] + near[back[1]]) + bias[:, 0]
            log_p = (logits - logits.max() - math.log(np.exp(logits - logits.max()).sum())) / math.log(10)
            place = at.get(w, 1 << 40)
            if place < lm.HEAD:
                total += log_p[lm.BUCKETS + place]
            else:
                b = zlib.crc32(w.encode()) % lm.BUCKETS
                s, n = rest.get(b, (0, 0))
                total += log_p[b] + math.log10((c.get(w, 0) + 1) / (s + n + 1))
            back = [back[1], place + 1 if place < lm.CONTEXTS - 1 else lm.OTHER]
        yield total


@pytest.mark.parametrize("frequent", [1 << 18, 1700])
def test_score_against_the_plain_formula(spark, sf, monkeypatch, frequent):
    """Whole scores, of words that are classes, in buckets, only in the table, and unknown."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    kept = []
    monkeypatch.setattr(lm, "fit", lambda df, own, fit=lm.fit: kept.append((fit(df, own), own)) or kept[0][0])
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in words(t))
    order = sorted(train, key=lambda w: (w != "\n", -train[w], w))
    params, own = kept[0]
    assert own.words.to_pylist() == order[: len(own.words)] and (frequent == 1 << 18) == (len(own.words) == len(order))
    assert list(plain_score([t for _, t in rows], params, own, train)) == pytest.approx([got[i] for i, _ in rows], rel=1e-4)


def test_shards_keep_gain(spark, monkeypatch):
    """Held-out gain over unigrams, log10 a token, of 64 partitions: in five shards more of it stays than in 64.

    A table below one shard and one block trains alike in any layout, so shards are small here.
    """
    df, gain = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(64, "doc_id"), {}
    for shard in (1, 60_000, lm.SHARD):
        monkeypatch.setattr(lm, "SHARD", shard)
        held = [r for r in lm.score(df).collect() if r.held_out]
        gain[shard] = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    few, some, whole = gain.values()
    assert few < some < whole and some > 0, gain


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "a A b"), (None, "c"), (5, "x" * 100000 + " " + "y " * 50000)]
    df = spark.createDataFrame([(i, t, 1, 0) for i, t in rows], "doc_id long, text string, uid int, score int")
    check(lm.score(df).collect(), rows)
    assert lm.score(df.limit(0)).count() == 0
    assert lm.score(df.where("doc_id = 2").union(df.where("doc_id = 2"))).count() == 2
