"""Quality classifier by importance resampling.

Words and word pairs are hashed to a fixed number of features. Two generative models count them: one of target text (a
bounded sample of rows that are labelled good), one of all rows. A document's log importance weight is the sum of the
features' log ratios; it is taken per feature, shrunk for short texts and tempered, so that long texts don't outweigh
others by length. Gumbel noise from a hash of the row is added, and the k rows with the highest sums are kept. k is the
number of rows whose weight reaches that of all but a few of the target sample, so it follows the data at every size.

Toxic rows are fluent, so they are told by a second ratio: of the share of rows of a bounded toxic sample that hold a word
to the share of target rows that do, for words that are in clearly more toxic rows than chance would have. A row is
rejected, before k is set, if its words' log ratios add up to more than those of all but a few of the target sample, and
to more than the log of 1 / ``LOSS``.

Defined results: null and empty texts have weight 0 and are kept like other texts that say nothing; without any target
row all weights are 0 and all rows are kept; without any toxic one none is rejected as such; repeated rows have the same sum and are kept or not together, as are ties
at the last place; null ids take part. Sizes on the driver are bounded: ``FEATURES`` counts, ``TARGETS`` ids of each kind and
words of the toxic sample.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, blocks, mix64, texts, tokens, word_hashes

FEATURES, TARGETS = 1 << 16, 20_000
#: Features that count for a text beside its own; share of target rows below the cut; scale of the noise.
SHRINK, LOSS, TEMPER, SEED = 20, 0.004, 0.004, 9
#: Toxic rows that a word must be in, and by how many standard deviations more than by chance.
LEAST, CLEAR = 3, 5.0
#: Bytes of text that a worker takes features of at once, unless one document alone is longer; features need many times that.
BLOCK = 1 << 19


def words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and the text of each."""
    flat, counts = tokens(text)
    return flat, np.repeat(np.arange(len(counts)), counts)


def bare(flat: pa.Array) -> np.ndarray:
    """Hashes of the words without the punctuation around them."""
    return word_hashes(pc.ascii_trim(flat, characters=string.punctuation))


def paired_up(flat: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of words and word pairs, and the text of each."""
    word = word_hashes(flat)
    paired = np.flatnonzero(owner[1:] == owner[:-1])
    pair = mix64(word[paired] * np.uint64(3) + word[paired + 1])
    return (np.concatenate([mix64(word), pair]) % np.uint64(FEATURES)).astype(np.int64), np.concatenate([owner, owner[paired]])


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word pairs of all texts, and the text of each."""
    return paired_up(*words(text))


def sample_ids(labels: DataFrame, condition: str) -> set:
    """A bounded sample of the ids with such a label: the first by hash."""
    some = labels.where(condition).where("doc_id is not null").select("doc_id").distinct()
    return {r.doc_id for r in some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGETS).collect()}


def target_ids(labels: DataFrame) -> set:
    """Ids labelled good."""
    return sample_ids(labels, "quality = 1 and toxic = 0")


def toxic_words(df: DataFrame, targets: set, toxic: set) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of words that mark toxic rows, and their log ratios."""
    none = np.zeros(0, np.uint64), np.zeros(0)
    if not targets or not toxic:
        return none
    every = list(targets | toxic)
    kind = T.StructType([T.StructField("doc_id", df.schema["doc_id"].dataType), T.StructField("bad", T.BooleanType())])
    # an Arrow table: rows from a list are pickled again by Python workers, which stay beside those of the stages that follow
    ids = df.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(every), "bad": pa.array([i in toxic for i in every])}), kind)
    sample = df.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "bad")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=BLOCK):
            flat, owner = words(texts(batch))
            word = bare(flat)
            bad = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            order = np.lexsort((word, owner))
            word, owner = word[order], owner[order]
            fresh = np.ones(len(word), bool)
            fresh[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
            each, which = np.unique(word[fresh], return_inverse=True)
            mine = bad[owner[fresh]]
            t, g = (np.bincount(which[m], minlength=len(each)).astype(np.int64) for m in (mine, ~mine))
            yield pa.RecordBatch.from_arrays([pa.array([None, *each.view(np.int64).tolist()], pa.int64()), pa.array([int(bad.sum()), *t.tolist()]), pa.array([int((~bad).sum()), *g.tolist()])], ["word", "t", "g"])

    counts = sample.mapInArrow(run, "word long, t long, g long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("g").alias("g"))
    counts = Scratch(df.sparkSession).table(counts)
    whole = counts.where("word is null").first()  # a row for each text
    if whole is None or not whole.t or not whole.g:
        return none
    share = whole.t / (whole.t + whole.g)
    expected = (F.col("t") + F.col("g")) * share
    clear = (F.col("t") >= LEAST) & (F.col("t") - expected >= CLEAR * F.sqrt(expected * (1 - share)))
    ratio = F.log((F.col("t") + 0.5) / (whole.t + 1)) - F.log((F.col("g") + 0.5) / (whole.g + 1))
    rows = counts.where("word is not null").where(clear).select("word", ratio.alias("ratio")).collect()
    word = np.array([r.word for r in rows], np.int64).view(np.uint64)
    order = np.argsort(word)
    return word[order], np.array([r.ratio for r in rows], float)[order]


def toxicity(word: np.ndarray, owner: np.ndarray, n: int, marks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The sum of the log ratios of each text's marking words."""
    names, ratio = marks
    if not len(names):
        return np.zeros(n)
    at = np.minimum(np.searchsorted(names, word), len(names) - 1)
    hit = names[at] == word
    return np.bincount(owner[hit], ratio[at[hit]], minlength=n).astype(float)


def fit(df: DataFrame, targets: set) -> np.ndarray:
    """Log ratio of each feature's share in target rows to its share in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
        for batch in blocks(batches, limit=BLOCK):
            feature, owner = features(texts(batch))
            mine = np.array([i in targets for i in batch.column(0).to_pylist()], bool)
            raw += np.bincount(feature, minlength=FEATURES)
            good += np.bincount(feature[mine[owner]], minlength=FEATURES)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], ["feature", "raw", "good"])

    counts = df.select("doc_id", "text").mapInArrow(run, "feature long, raw long, good long").groupBy("feature").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, good = np.ones(FEATURES), np.ones(FEATURES)
    for r in counts.collect():  # at most FEATURES rows
        raw[r.feature] += r.raw
        good[r.feature] += r.good
    if good.sum() == FEATURES:
        return np.zeros(FEATURES)
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def scored(df: DataFrame, ratio: np.ndarray, targets: set, marks: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """df with its columns as _0, _1, ..., and n_grams, log_ratio, toxicity, weight, target and key."""
    names = df.columns
    held = df.select([F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)])
    fields = ", ".join(f"{c} {t}" for c, t in held.dtypes)
    text, ident = f"_{names.index('text')}", names.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text, BLOCK):
            flat, of = words(texts(batch, text))
            feature, owner = paired_up(flat, of)
            n = np.bincount(owner, minlength=batch.num_rows)
            total = np.bincount(owner, ratio[feature], minlength=batch.num_rows)
            mine = pa.array([i in targets for i in batch.column(ident).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n.astype(np.int64)), pa.array(total.astype(float)), pa.array(toxicity(bare(flat), of, batch.num_rows, marks)), mine], [*batch.schema.names, "n_grams", "log_ratio", "toxicity", "target"])

    out = held.mapInArrow(run, f"{fields}, n_grams long, log_ratio double, toxicity double, target boolean")
    out = out.withColumn("weight", F.col("log_ratio") / (F.col("n_grams") + SHRINK))
    unit = (F.pmod(F.xxhash64(f"_{ident}", text, F.lit(SEED)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return out.withColumn("key", F.col("weight") / TEMPER - F.log(-F.log(unit)))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by histograms that narrow down on it; a few thousand values at most reach the driver."""
    rest, low, high = df.select(F.col(column).alias("x")), None, None
    while True:
        here = rest if low is None else rest.where(F.col("x").between(low, high))
        n, a, b = here.agg(F.count("x"), F.min("x"), F.max("x")).first()
        if a == b:
            return a
        if n <= 4096:
            return sorted((r.x for r in here.collect()), reverse=True)[k - 1]
        step = (b - a) / 1024
        cell = F.least(F.floor((F.col("x") - a) / step), F.lit(1023)).alias("cell")
        for r in here.groupBy(cell).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy(F.desc("cell")).collect():
            if k <= r.n:
                low, high = r.a, r.b
                break
            k -= r.n


def decide(df: DataFrame, labels: DataFrame) -> tuple[tuple, object]:
    """What scored() takes after df, and the condition on its rows for being kept."""
    targets = target_ids(labels)
    marks = toxic_words(df, targets, sample_ids(labels, "toxic = 1"))
    model = fit(df, targets), targets, marks
    rows = Scratch(df.sparkSession).table(scored(df.select("doc_id", "text"), *model).select("weight", "toxicity", "target", "key"))
    cuts = F.percentile_approx("weight", LOSS, 10_000), F.percentile_approx("toxicity", 1 - LOSS, 10_000)
    cut, most = rows.where("target").agg(*cuts).first()  # of at most TARGETS ids
    clean = F.col("toxicity") <= max(most or 0.0, -float(np.log(LOSS)))  # by chance, a likelihood ratio of 1 / LOSS is as rare as LOSS
    rows = rows.where(clean)
    k = rows.count() if cut is None else rows.where(F.col("weight") >= cut).count()
    return model, clean & (F.col("key") >= (kth_largest(rows, "key", k) if k else float("-inf")))


def classify(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_grams, log_ratio, weight and kept for each row of df (doc_id, text)."""
    model, kept = decide(df, labels)
    rows = scored(df.select("doc_id", "text"), *model)
    return rows.select(F.col("_0").alias("doc_id"), "n_grams", "log_ratio", "weight", kept.alias("kept"))


def keep_good(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows and columns of df that are kept."""
    model, kept = decide(df, labels)
    rows = scored(df, *model).where(kept)
    return rows.select([F.col(f"_{i}").alias(c) for i, c in enumerate(df.columns)])
