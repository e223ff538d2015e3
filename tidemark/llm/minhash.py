"""Near-duplicate components by one-permutation hashing with optimal densification.

Each document's set of word shingles is reduced to one minimum per bin of a single permutation; empty bins borrow from
full ones by a random walk that is the same for all sets. Bands of bins make buckets. In each bucket that still spans
more than one component, the member that shares most buckets is a centre and is compared with the members of other
components only, so edges form a star and pair counts stay near the number of members; a pair is made in the first band that its
two share. Centres leave, components merge, and later rounds take more centres a bucket; a bucket ends when its members are in one component or all pairs of
different components were compared, in the end all that are left at once. Pairs whose sizes, or whose numbers of shingles that no other candidate has, in all or
part by part, rule a link out aren't made. Every link is confirmed on the full sets. Nothing is capped or sampled.

Defined results: null and empty texts have an empty set and link with nothing; texts of fewer words than a shingle are
one shingle of all their words; repeated rows and copies have the same set and so the same component; a null id counts
only if its whole component has no other. Classes of equal sets are told apart by a 64-bit hash.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, mix64, texts, tokens, word_hashes
from .graph import components

SHINGLE = 5
ROWS, BANDS = 4, 24
BINS = ROWS * BANDS
#: Bands of the first round, which link most copies, so that the others needn't be looked at.
FIRST_BANDS = 2
#: Parts of a set, by the last bits of its hashes, in which what two sets can share is bounded.
PARTS = 32
#: From the third round of bounded pairs on, all pairs of the buckets are looked at at once where these are at most so many, or no
#: more than the centres would look at.
WHOLE = 1 << 25
#: Times as many centres a bucket in each round from the second of bounded pairs on.
GROWTH = 16


def donors() -> np.ndarray:
    """For each bin, the bins that it asks in turn when it is empty: random ones, then all."""
    rng = np.random.default_rng(20170)
    return np.concatenate([rng.integers(0, BINS, (BINS, 512)), np.array([np.roll(np.arange(BINS), -i) for i in range(BINS)])], axis=1)


def shingle_sets(text: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending in each, and each text's number of them."""
    flat, counts = tokens(text)
    word = mix64(word_hashes(flat))
    made = np.maximum(counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), made)
    first = np.cumsum(counts) - counts
    at = np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made) + first[owner]
    out = np.zeros(len(owner), np.uint64)
    padded = np.append(word, np.zeros(size, np.uint64))
    for k in range(size):
        inside = at + k < (first + counts)[owner]
        out = np.where(inside, mix64(out * np.uint64(0x9E3779B97F4A7C15) + padded[at + k]), out)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[fresh], owner[fresh]
    return out, np.bincount(owner, minlength=len(counts)).astype(np.int64)


def set_ids(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash for each set; of no use for empty ones."""
    out, full = np.zeros(len(sizes), np.int64), np.flatnonzero(sizes)
    if not len(full):
        return out
    start = (np.cumsum(sizes) - sizes)[full]  # of sets that aren't empty, so each sum ends where the next set starts
    once, twice = (np.add.reduceat(x, start) for x in (sets, mix64(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
    out[full] = mix64(mix64(once) + twice + sizes[full].astype(np.uint64)).view(np.int64)
    return out


def band_keys(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """BANDS bucket keys for each set that isn't empty."""
    full = np.flatnonzero(sizes)
    owner = np.repeat(np.arange(len(full)), sizes[full])
    place = ((sets >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    lead = np.ones(len(sets), bool)  # sets ascend, so the first of each bin is its minimum
    lead[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    grid, has = np.zeros((len(full), BINS), np.uint64), np.zeros((len(full), BINS), bool)
    grid[owner[lead], place[lead]], has[owner[lead], place[lead]] = sets[lead], True
    row, col = np.nonzero(~has)
    ask = donors()
    for t in range(ask.shape[1]):
        if not len(row):
            break
        giver = ask[col, t]
        ok = has[row, giver]
        grid[row[ok], col[ok]] = grid[row[ok], giver[ok]]
        row, col = row[~ok], col[~ok]
    keys = np.zeros((len(full), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(ROWS):
        keys = mix64(keys + grid[:, k::ROWS])
    return keys.view(np.int64)


def signatures(df: DataFrame) -> DataFrame:
    """doc_id, tk (hash of the text), n_shingles, fp (hash of the set; null: empty), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            sets, sizes = shingle_sets(texts(batch))
            keys = band_keys(sets, sizes)
            edges = np.append(0, np.cumsum((sizes > 0) * BANDS)).astype(np.int32)
            fp = pa.array(set_ids(sets, sizes), mask=sizes == 0)
            bands = pa.ListArray.from_arrays(pa.array(edges), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes), fp, bands], ["doc_id", "tk", "n_shingles", "fp", "bands"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text", F.xxhash64("text").alias("tk")).mapInArrow(run, f"doc_id {kind}, tk long, n_shingles long, fp long, bands array<long>")


def full_sets(df: DataFrame) -> DataFrame:
    """fp, the set itself and how many of it each part has, for each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            sets, sizes = shingle_sets(texts(batch))
            edges = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            place = np.repeat(np.arange(len(sizes)), sizes) * PARTS + (sets & np.uint64(PARTS - 1)).astype(np.int64)
            parts = np.bincount(place, minlength=len(sizes) * PARTS).astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * PARTS), pa.array(parts))
            yield pa.RecordBatch.from_arrays([pa.array(set_ids(sets, sizes)), pa.ListArray.from_arrays(edges, pa.array(sets.view(np.int64))), parts], ["fp", "own", "parts"])

    return df.select("text").mapInArrow(run, "fp long, own array<long>, parts array<int>")


def without_loners(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """fp, s, shared: bounds of what each set can share with one of another label. shared is its number of shingles in each
    part that such a set of these rows has, and s their sum; they hold as well where rows went or labels merged since.

    Sets that by this bound are too far from all others aren't there; no link is lost. Shingles of one label are counted by a
    join that reuses the exchange of the first pass.
    """
    each = sets.join(rows.select("fp", "label").distinct(), "fp").select("fp", "label", F.explode("own").alias("shingle")).repartition("shingle")
    lone = each.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low = high").select("shingle")
    part = F.col("shingle").bitwiseAND(PARTS - 1)
    alone = each.join(lone, "shingle", "left_semi").groupBy("fp").agg(F.count("*").alias("alone"), F.array(*[F.count(F.when(part == p, 1)).cast("int") for p in range(PARTS)]).alias("gone"))
    shared = F.when(F.col("gone").isNull(), F.col("parts")).otherwise(F.array(*[F.col("parts")[p] - F.col("gone")[p] for p in range(PARTS)]))
    bound = sets.select("fp", "parts", F.size("own").alias("n")).join(alone, "fp", "left").select("fp", "n", shared.alias("shared"), (F.col("n") - F.coalesce("alone", F.lit(0))).alias("s"))
    return bound.where(F.col("s") * 100 >= F.col("n") * percent).drop("n")


def near_duplicates(df: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, tk, n_shingles, component_id, kept, group; a row for each row of df (doc_id, text).

    group tells components apart where ids don't (null: no words).

    Rows link if 100 * intersection >= percent * union of their sets, and components are of linked rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    found = scratch.table(signatures(df))
    classes = found.where("fp is not null").groupBy("fp").agg(F.min("n_shingles").alias("n"), F.min(F.struct("doc_id", "tk")).alias("row"), F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    classes = scratch.table(classes)
    rows = classes.select("fp", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = scratch.table(rows.groupBy("bucket").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("*").alias("many")).where("low < high").select("bucket", "many"))
    rows = scratch.table(rows.join(shared, "bucket"))
    central = scratch.table(rows.groupBy("fp").agg(F.sum("many").alias("degree")))
    rows = scratch.table(rows.drop("many").join(central, "fp").withColumn("s", F.col("n")))

    wanted = scratch.table(rows.select("fp").distinct().join(classes, "fp").select(F.col("row.doc_id").alias("id"), F.col("row.tk").alias("key")))
    own = df.select("doc_id", "text", F.xxhash64("text").alias("tk")).hint("merge").join(wanted, F.expr("doc_id <=> id and tk = key"), "left_semi")
    sets = scratch.table(full_sets(own).groupBy("fp").agg(F.first("own").alias("own"), F.first("parts").alias("parts")))

    label = None  # (node, label) of the sets that have been linked
    turn, centres, since = 0, 1, 0  # since: links found after the bounds were made
    while True:
        here = rows.withColumn("label", F.col("fp")) if label is None else rows.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        if turn:  # at first, each bucket has several labels
            here = scratch.table(here)
            mixed = here.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("many")).where("low < high").select("bucket", "many")
            here = scratch.table(here.join(mixed, "bucket"))
        size, looks = here.agg(F.count("*"), F.sum("many") if turn else F.lit(0)).first()
        if not size:
            break
        whole = turn > 2 and looks <= max(size * centres, WHOLE)  # all pairs of each bucket, each once, which ends the search
        once = F.lit(True)  # whether a pair's turn is in this band, and it can share enough
        if turn:
            if turn == 1 or since * 100 >= size:
                bounds = scratch.table(without_loners(here, sets, percent).join(classes.select("fp", "bands"), "fp"))
                since = 0
            here = scratch.table(here.drop("s").join(bounds, "fp"))
            both = functools.reduce(Column.__add__, [F.least(F.col("shared")[p], F.col("theirs")[p]) for p in range(PARTS)])
            once = both * (100 + percent) >= (F.col("n") + F.col("na")) * percent
            if whole:  # bands stay out of a join that has all rows on both sides; the few pairs that meet again are told apart below
                once = (F.col("fp") < F.col("a")) & once
            else:
                same = [F.when(F.col("bands")[i] == F.col("others")[i], i) for i in range(BANDS)]  # no lambda, so that the join is compiled
                once = once & (F.coalesce(*same) == F.col("band"))
        extra = {"shared": "theirs"} if whole else {"bands": "others", "shared": "theirs"} if turn else {}
        part = F.col("fp") if whole else F.pmod(F.xxhash64("fp", F.lit(turn)), F.lit(centres))
        chosen = here.where(F.col("band") < FIRST_BANDS) if turn == 0 else here
        chosen = chosen.groupBy("bucket", part.alias("part")).agg(F.max(F.struct("degree", "fp", "n", "s", "label", *extra)).alias("c"))
        chosen = scratch.table(chosen.select("bucket", F.col("c.fp").alias("a"), F.col("c.n").alias("na"), F.col("c.s").alias("sa"), F.col("c.label").alias("la"), *[F.col(f"c.{x}").alias(y) for x, y in extra.items()]))
        most = F.least("s", "sa", "n", "na")  # words that the two can share
        pairs = here.join(chosen, "bucket").where((F.col("label") != F.col("la")) & (most * 100 >= (F.col("n") + F.col("na") - most) * percent) & once)
        pairs = scratch.table(pairs.select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"), F.when(F.col("a") < F.col("fp"), F.col("la")).otherwise(F.col("label")).alias("la"), F.when(F.col("a") < F.col("fp"), F.col("label")).otherwise(F.col("la")).alias("lb")).distinct())
        with_b = pairs.join(sets.select(F.col("fp").alias("b"), F.col("own").alias("other")), "b")
        both = with_b.join(sets.select(F.col("fp").alias("a"), "own"), "a")
        inter = F.size(F.array_intersect("own", "other"))
        links = scratch.table(both.where(inter * 100 >= (F.size("own") + F.size("other") - inter) * percent).select(F.col("la").alias("u"), F.col("lb").alias("v")).distinct())
        many = links.count()
        if many:
            since += many
            merged = components(links, scratch)
            if label is None:
                label = merged
            else:
                moved = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
                old = label.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
                fresh = merged.join(label, "node", "left_anti")
                label = scratch.table(old.union(fresh.select("node", "label")))
        if whole:
            break
        rows = here.drop("label", "many", "bands", "shared").join(chosen.select("bucket", F.col("a").alias("fp")), ["bucket", "fp"], "left_anti")
        turn += 1
        centres *= 1 if turn < 2 else GROWTH
    final = classes.select("fp", "least")
    final = final.withColumn("label", F.col("fp")) if label is None else final.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    final = scratch.table(final)
    least = scratch.table(final.groupBy("label").agg(F.min("least").alias("component_id")))
    final = scratch.table(final.join(least, "label").select("fp", "component_id", F.col("label").alias("group")))
    scratch.clear(found, final)
    out = found.select("doc_id", "tk", "n_shingles", "fp").join(final, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "tk", "n_shingles", component.alias("component_id"), "group").withColumn("kept", F.expr("doc_id <=> component_id"))
