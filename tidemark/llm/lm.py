"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation, beside smoothed unigrams.

Tokens are lower-cased words and one end for each text. Counts cover all training rows. The end and the most frequent words
are classes of the model by themselves; all others share ``BUCKETS`` classes by the hash of the word, in which they are told
apart by their smoothed counts, so probabilities are normalised over known words and one unknown in each bucket. The model
adds an embedding of each of the two words before (those beyond the ``CONTEXTS`` first are alike there), takes the product
with each class's own embedding, and adds a bias. Partitions with training rows are joined to shards
of about ``SHARD`` tokens where they are smaller, since averaging many that saw little loses most of what they learnt; scores
still depend on which rows share a shard. Each shard trains on all of its tokens (as weighted triples of classes) from common
parameters; the shards' parameters are averaged, weighted by tokens, twice. Contexts that are equal are scored once, as
batched matrix products.

Counts of the ``FREQUENT`` words go to the workers, a fixed number; all rarer words are joined with their counts by a
shuffle, and by their rarity none of them is hot.

Defined results: a null text counts as empty and has one token, its end; null ids train; every row in gives a row out,
repeated rows included; with no training rows all scores are those of the prior. Other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, texts, tokens

CLASSES, BUCKETS, CONTEXTS, WIDTH, FREQUENT = 2048, 512, 1024, 16, 1 << 18
HEAD = CLASSES - BUCKETS  # the end and the words that are classes; class of a place among these: BUCKETS + place
ROUNDS, BATCH, SHARED, NOISE, RATE, GROUPS, SHARD = 2, 4096, 128, 16, 0.3, 16, 1 << 21
BLOCK = 4 << 20
TOGETHER = 128  # contexts whose scores are worked out at once, in two arrays that stay in a core's cache
OTHER, END, BEGIN = 0, BUCKETS, CONTEXTS  # OTHER and BEGIN only stand in contexts, where a place is one more
END_WORD = "\n"  # no word holds it


def with_fold(df: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return df.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", held.alias("held_out"))


def counts(df: DataFrame) -> DataFrame:
    """token, c: how often each occurs in training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=BLOCK):
            flat, _ = tokens(texts(batch))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([END_WORD]), pa.array([batch.num_rows])], ["token", "n"])
            if len(flat):
                made = pc.value_counts(flat)
                yield pa.RecordBatch.from_arrays([made.field("values").cast(pa.string()), made.field("counts")], ["token", "n"])

    return df.where(~F.col("held_out")).select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


def bucket_of(token):
    """The bucket of a word that is no class, as a column; the same as of ``buckets``."""
    return (F.crc32(token.cast("binary")) % BUCKETS).cast("int")


def buckets(words: list[str]) -> np.ndarray:
    return crcs([w.encode() for w in words])


def crcs(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS


class Words:
    """The frequent words with their counts, the classes first, and totals of the training text.

    rest: by bucket, the sum of counts and the number of the words that aren't among the frequent ones.
    """

    def __init__(self, words: list[str], c: list[int], total: int, distinct: int, rest: tuple[np.ndarray, np.ndarray] | None = None):
        self.words, self.c = pa.array(words, pa.large_string()), np.array(c, np.int64)
        self.total, self.distinct = total, distinct
        own = buckets(words[HEAD:])
        self.bucket = np.append(np.zeros(min(HEAD, len(words)), np.int16), own.astype(np.int16))  # of each frequent word
        shared, kinds = np.bincount(own, self.c[HEAD:], minlength=BUCKETS), np.bincount(own, minlength=BUCKETS)
        if rest is not None:
            shared, kinds = shared + rest[0], kinds + rest[1]
        self.prior = np.concatenate([shared, self.c[:HEAD]]).astype(float)
        self.prior = np.append(self.prior, np.zeros(CLASSES - len(self.prior))) + 0.5
        self.prior /= self.prior.sum()
        self.log_others = np.log10(shared + kinds + 1)

    def look_up(self, flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place among the frequent words, or -1; and the bucket of words that are no class."""
        coded = flat.dictionary_encode()
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        bucket, rare = self.bucket[place].astype(np.int64), place < 0
        bucket[rare] = crcs(coded.dictionary.filter(pa.array(rare)).cast(pa.large_binary()).to_pylist())
        which = coded.indices.to_numpy(zero_copy_only=False)
        return (place[which], bucket[which]) if len(flat) else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def laid_out(place: np.ndarray, bucket: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token, ends included: the class, the contexts one and two before it, and the text."""
    total = size + 1
    owner = np.repeat(np.arange(len(size)), total)
    last = np.cumsum(total) - 1
    own, before = np.full(len(owner), END), np.full(len(owner), OTHER)
    word = np.ones(len(owner), bool)
    word[last] = False
    own[word] = np.where((place >= 0) & (place < HEAD), place + BUCKETS, bucket)
    before[word] = np.where((place >= 0) & (place < CONTEXTS - 1), place + 1, OTHER)
    one, two = np.full(len(owner), BEGIN), np.full(len(owner), BEGIN)
    one[1:], two[2:] = before[:-1], before[:-2]
    first = last - size
    one[first] = BEGIN
    two[first] = BEGIN
    second = (first + 1)[size > 0]
    two[second] = BEGIN
    return own, one, two, owner


SIZES = [(CONTEXTS + 1, WIDTH), (CONTEXTS + 1, WIDTH), (CLASSES, WIDTH), (CLASSES, 1)]


def initial(words: Words) -> list[np.ndarray]:
    rng = np.random.default_rng(2)
    made = [rng.normal(0, 0.1, s).astype(np.float32) for s in SIZES]
    made[3] = np.log(words.prior)[:, None].astype(np.float32)
    return made


def scatter(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the rows of values by index."""
    width = values.shape[1]
    flat = (index[:, None] * width + np.arange(width)).ravel()
    return np.bincount(flat, values.ravel(), minlength=rows * width).reshape(rows, width).astype(np.float32)


def train(params: list[np.ndarray], squares: list[np.ndarray], triples: np.ndarray, weight: np.ndarray, prior: np.ndarray, seed: int) -> None:
    """One pass of noise-contrastive estimation over weighted triples (two before, one before, class), in place."""
    far, near, out, bias = params
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(triples))
    log_noise = np.log(NOISE * prior).astype(np.float32)
    held = np.empty((BATCH, SHARED), np.float32)
    for at in range(0, len(order), BATCH):
        pick = order[at : at + BATCH]
        two, one, own = triples[pick].T
        w = weight[pick].astype(np.float32)
        w /= w.sum()
        noise = rng.choice(CLASSES, SHARED, p=prior)
        h = far[two] + near[one]
        good = (h * out[own]).sum(1) + bias[own, 0] - log_noise[own]
        bad = np.matmul(h, out[noise].T, out=held[: len(pick)])
        bad += bias[noise, 0] - log_noise[noise]
        pull = w / (1 + np.exp(np.clip(good, -30, 30)))  # w * (1 - sigmoid)
        push = np.exp(np.clip(np.negative(bad, out=bad), -30, 30, out=bad), out=bad)
        push += 1
        np.divide(-(NOISE / SHARED) * w[:, None], push, out=push)
        dh = pull[:, None] * out[own] + push @ out[noise]
        d_out = scatter(own, pull[:, None] * h, CLASSES) + scatter(noise, push.T @ h, CLASSES)
        d_bias = scatter(own, pull[:, None], CLASSES) + scatter(noise, push.sum(0)[:, None], CLASSES)
        for p, s, d in ((far, squares[0], scatter(two, dh, CONTEXTS + 1)), (near, squares[1], scatter(one, dh, CONTEXTS + 1)), (out, squares[2], d_out), (bias, squares[3], d_bias)):
            s += d * d
            p += RATE * d / (np.sqrt(s) + 1e-6)


def packed(own: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (two * (CONTEXTS + 1) + one) * CLASSES + own


def unpacked(code: np.ndarray) -> np.ndarray:
    rest, own = np.divmod(code, CLASSES)
    two, one = np.divmod(rest, CONTEXTS + 1)
    return np.column_stack([two, one, own])


def fit(df: DataFrame, words: Words) -> list[np.ndarray]:
    """Parameters after ROUNDS of training in all shards and averaging; at most GROUPS rows reach the driver."""
    params = initial(words)
    rows = df.where(~F.col("held_out")).select("text").coalesce(max(1, words.total // SHARD))
    shape = [np.prod(s) for s in SIZES]

    def averaged(part: pa.Table) -> pa.Table:
        weight = part.column("weight").to_numpy().astype(float)
        total = sum(w * np.frombuffer(p, np.float32).astype(float) for w, p in zip(weight, part.column("params").to_pylist(), strict=True)) / weight.sum()
        return pa.table({"part": part.column("part")[:1], "weight": [int(weight.sum())], "params": [total.astype(np.float32).tobytes()]})

    for turn in range(ROUNDS):
        start = np.concatenate([p.ravel() for p in params]).astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            own = [x.reshape(s).copy() for x, s in zip(np.split(start, np.cumsum(shape)[:-1]), SIZES, strict=True)]
            squares = [np.full(s, 1e-4, np.float32) for s in SIZES]
            seen = 0
            for n, batch in enumerate(blocks(batches, limit=BLOCK)):
                flat, size = tokens(texts(batch))
                c, one, two, _ = laid_out(*words.look_up(flat), size)
                code, weight = np.unique(packed(c, one, two), return_counts=True)
                train(own, squares, unpacked(code), weight, words.prior, 1000 * turn + n)
                seen += len(c)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([part % GROUPS]), pa.array([seen]), pa.array([np.concatenate([p.ravel() for p in own]).astype(np.float32).tobytes()], pa.binary())], ["part", "weight", "params"])

        schema = "part long, weight long, params binary"
        done = rows.mapInArrow(run, schema).groupBy("part").applyInArrow(averaged, schema).collect()
        if done:
            whole = sum(r.weight for r in done)
            mean = sum(r.weight / whole * np.frombuffer(bytes(r.params), np.float32).astype(float) for r in done)
            params = [x.reshape(s).astype(np.float32) for x, s in zip(np.split(mean, np.cumsum(shape)[:-1]), SIZES, strict=True)]
    return params


def class_scores(params: list[np.ndarray], own: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """log10 of the normalised probability of each class after the two before it."""
    far, near, out, bias = params
    code, back = np.unique(packed(own, one, two), return_inverse=True)
    triples = unpacked(code)
    context, which = np.unique(triples[:, 0] * (CONTEXTS + 1) + triples[:, 1], return_inverse=True)
    found = np.empty(len(code))
    edge = np.searchsorted(which, np.arange(0, len(context) + TOGETHER, TOGETHER))
    across, held = np.ascontiguousarray(out.T), np.empty((2, TOGETHER, CLASSES), np.float32)
    for k, at in enumerate(range(0, len(context), TOGETHER)):
        some = context[at : at + TOGETHER]
        logits, above = held[:, : len(some)]
        np.matmul(far[some // (CONTEXTS + 1)] + near[some % (CONTEXTS + 1)], across, out=logits)
        logits += bias[:, 0]
        top = logits.max(1, keepdims=True)
        np.exp(np.subtract(logits, top, out=above), out=above)
        norm = top[:, 0] + np.log(above.sum(1))
        span = slice(edge[k], edge[k + 1])
        local = which[span] - at
        found[span] = (logits[local, triples[span, 2]].astype(float) - norm[local]) / np.log(10)
    return found[back]


def frequent(table: DataFrame) -> list:
    """The most frequent words, FREQUENT at most, and the end: whole classes of counts (sixteenths of a doubling), so that no
    partition sends more than what is taken. A word that isn't taken has at most one in FREQUENT of all tokens, or nearly."""
    level = F.floor(F.log2("c") * 16).cast("int")
    held, least = 0, None
    for r in table.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # a thousand rows at most
        if held + r.n >= FREQUENT:
            break
        held, least = held + r.n, r.level
    chosen = F.col("token") == END_WORD
    return table.where(chosen if least is None else chosen | (level >= least)).collect()


def score(df: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of df (doc_id, text)."""
    scratch = Scratch(df.sparkSession)
    rows = with_fold(df)
    table = scratch.table(counts(rows))
    totals = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = sorted(frequent(table), key=lambda r: (r.token != END_WORD, -r.c, r.token))
    names, own = [r.token for r in top], [r.c for r in top]
    if not names or names[0] != END_WORD:
        names, own = [END_WORD, *names], [0, *own]
    held = buckets(names)
    rest = [-np.bincount(held, own, minlength=BUCKETS), -np.bincount(held, np.array(own) > 0, minlength=BUCKETS)]  # all words less those
    for r in table.groupBy(bucket_of(F.col("token")).alias("b")).agg(F.sum("c").alias("s"), F.count("*").alias("n")).collect():  # BUCKETS rows
        rest[0][r.b] += r.s
        rest[1][r.b] += r.n
    words = Words(names, own, totals[0], totals[1], tuple(rest))
    params = fit(rows, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = words.c > 0, np.log10(words.c + 1.0)
        for batch in blocks(batches, limit=BLOCK):
            flat, size = tokens(texts(batch))
            place, bucket = words.look_up(flat)
            c, one, two, owner = laid_out(place, bucket, size)
            each = class_scores(params, c, one, two)
            shared = c < BUCKETS
            each[shared] -= words.log_others[c[shared]]
            n = batch.num_rows
            rare = place < 0
            word_owner = np.repeat(np.arange(n), size)
            common = np.where(rare, 0, logs[np.maximum(place, 0)])
            in_others = np.where(~rare & (place >= HEAD), common, 0)
            base = np.bincount(word_owner, common, minlength=n) + logs[0]
            model = np.bincount(owner, each, minlength=n) + np.bincount(word_owner, in_others, minlength=n)
            seen = np.bincount(word_owner[~rare], minlength=n) + int(known[0])
            edges = np.append(0, np.cumsum(np.bincount(word_owner[rare], minlength=n))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(size + 1), pa.array(seen.astype(np.int64)), pa.array(base.astype(float)), pa.array(model.astype(float)), pa.ListArray.from_arrays(pa.array(edges), flat.filter(pa.array(rare)).cast(pa.string()))],
                ["uid", "doc_id", "held_out", "n_tokens", "seen", "base", "model", "rare"],
            )

    kind = df.schema["doc_id"].dataType.simpleString()
    part = scratch.table(rows.mapInArrow(run, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, seen long, base double, model double, rare array<string>"))
    rare = part.select("uid", F.explode("rare").alias("token")).join(table, "token")
    rare = rare.groupBy("uid").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count("*").alias("known"))
    norm = float(np.log10(words.total + words.distinct + 1))
    more = F.coalesce("more", F.lit(0.0))
    out = part.drop("rare").join(rare, "uid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * norm).alias("base_score"), (F.col("model") + more).alias("score"),
    )
