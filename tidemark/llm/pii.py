"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Seeds are matches of four patterns (email, ip, card, phone), whole, with the blanks that they hold. Instances are the
seeds and all other tokens that hold a digit or an @; the words left and right of an instance, the bounds of the text among
them, are lexical patterns, alone and together. Digits of a word count as alike, and so do seeds. Scores pass over the graph
of patterns and instances: a pattern is as good as its instances on average, less what few instances say; an instance is
found if any of its patterns holds. Seeds stay at 1. After some rounds the instances that good patterns support, and not
fewer of these than of others, give further spans, kind "context". Identifiers without a digit and an @ aren't looked for.

Defined results: a null text counts as empty; every row in gives a row out, repeated rows and null ids included; other
columns play no part. Offsets count code points, ends exclusive. Patterns and instances are aggregated before each join,
and joins are on plain keys, so a frequent word or token is split by the engine. The regular expressions use possessive
loops and look-behind where these match the same, so long runs of one character take linear time and no deep stack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LOCAL = "A-Za-z0-9._%+-"
KINDS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's pattern to be tried.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
#: What seeds are masked by, and what it gives way to in a text that has it.
MASK, SPARE = "\uE000", "_"
TOKEN = rf"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@{MASK}]*+[0-9@{MASK}][^\x20\x09-\x0D]*+"
#: Words for the bounds of a text; no word holds a blank.
BEGIN, END = " begin", " end"
FOUND = "context"
#: Rounds of scoring, and what a pattern and an instance must reach.
ROUNDS, GOOD_PATTERN, GOOD_INSTANCE = 3, 0.8, 0.9


def valid(kind: str, value):
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "ip":
        return F.forall(F.split(value, "[.]"), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255))
    return F.lit(True)


def located(pieces, matches):
    """Start of each match from the lengths of what stands between matches."""
    steps = F.zip_with(F.transform(F.slice(pieces, F.lit(1), F.size(matches)), F.length), F.transform(matches, F.length), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(steps, zero, lambda acc, s: F.struct((acc.at + s.a + s.b).alias("at"), F.concat(acc.out, F.array(acc.at + s.a)).alias("out"))).out


def base_spans(df: DataFrame) -> DataFrame:
    """doc_id, tk, text and base: array of (start, k, end, value), kinds in the order of KINDS, sorted."""
    df = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tk", F.xxhash64("text"))
    for k, (kind, pattern) in enumerate(KINDS.items()):
        hint = F.contains("text", F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
        df = df.withColumn("m", F.when(hint, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
        df = df.withColumn("at", F.when(F.size("m") > 0, located(F.split("text", pattern, -1), F.col("m"))).otherwise(F.array().cast("array<int>")))
        spans = F.zip_with("at", "m", lambda a, m: F.struct(a.alias("start"), F.lit(k).alias("k"), (a + F.length(m)).alias("end"), m.alias("value")))
        df = df.withColumn(kind, F.filter(spans, lambda s: valid(kind, s.value))).drop("m", "at")
    return df.withColumn("base", F.array_sort(F.concat(*KINDS)))


def cover(kind: str):
    return lambda m: F.when(valid(kind, m), F.rpad(F.lit(MASK), F.length(m), F.lit(MASK))).otherwise(m)


def masked(df: DataFrame) -> DataFrame:
    """Rows of base_spans with hidden: the text, each seed as so many MASK characters."""
    df = df.withColumn("hidden", F.translate("text", MASK, SPARE))
    for kind, pattern in KINDS.items():
        found = F.regexp_extract_all("hidden", F.lit(pattern), F.lit(0))
        covered = F.transform(found, cover(kind))
        woven = F.array_join(F.flatten(F.zip_with(F.split("hidden", pattern, -1), covered, lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), "")
        df = df.withColumn("hidden", F.when(F.size(kind) > 0, woven).otherwise(F.col("hidden")))
    return df


def tokens_of(df: DataFrame) -> DataFrame:
    """df with tokens: array of (start, end, value, seed, left, right), each instance. From rows of base_spans."""
    df = masked(df).withColumn("m", F.regexp_extract_all("hidden", F.lit(TOKEN), F.lit(0)))
    df = df.withColumn("pieces", F.when(F.size("m") > 0, F.split("hidden", TOKEN, -1)))
    df = df.withColumn("at", F.when(F.size("m") > 0, located(F.col("pieces"), F.col("m"))))
    df = df.withColumn("pieces", F.transform("pieces", lambda p: F.trim(F.translate(p, "\t\n\x0b\x0c\r", "     "))))
    shape = lambda w: F.regexp_replace(F.regexp_replace(F.lower(w), "[0-9]", "#"), f"{MASK}+", MASK)
    beside = lambda i, outer: F.when(i.between(0, F.size("m") - 1), F.get("m", i)).otherwise(F.lit(outer))

    def one(m, i):
        before, after = F.get("pieces", i), F.get("pieces", i + 1)
        left = F.when(before == "", beside(i - 1, BEGIN)).otherwise(F.substring_index(before, " ", -1))
        right = F.when(after == "", beside(i + 1, END)).otherwise(F.substring_index(after, " ", 1))
        start = F.get("at", i)
        seed = F.contains(m, F.lit(MASK))
        value = F.when(seed, F.concat_ws(":", F.lit(MASK), F.col("tk").cast("string"), start.cast("string"))).otherwise(m)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), value.alias("value"), seed.alias("seed"), shape(left).alias("left"), shape(right).alias("right"))

    return df.withColumn("tokens", F.transform("m", one)).drop("hidden", "m", "pieces", "at")


def good_instances(tokens: DataFrame, scratch: Scratch) -> DataFrame:
    """Values, none of them seeds, that the graph of patterns and instances scores well."""
    patterns = F.array(*[F.concat(F.lit(f"{side}:"), F.col(side)) for side in ("left", "right")], F.concat(F.lit("both:"), "left", F.lit(" "), "right"))
    edges = tokens.select("value", "seed", F.explode(patterns).alias("pattern"))
    edges = scratch.table(edges.groupBy("value", "pattern").agg(F.max(F.col("seed").cast("double")).alias("seed")))
    scored = edges.select("value", "pattern", "seed", F.col("seed").alias("score"))
    for _ in range(ROUNDS):
        n = F.count("*")
        by_pattern = scratch.table(scored.groupBy("pattern").agg((F.sum("score") / n * (1 - 1 / (1 + n))).alias("p"), n.alias("n")).where(F.col("n") > 1))
        linked = edges.join(by_pattern, "pattern")
        good = F.col("p") >= GOOD_PATTERN
        holds = F.when(good, F.log(1 - F.least("p", F.lit(0.999)))).otherwise(0.0)
        by_value = scratch.table(linked.groupBy("value").agg((1 - F.exp(F.sum(holds))).alias("score"), F.sum(good.cast("int")).alias("support"), n.alias("linked"), F.max("seed").alias("s")))
        supported = F.when(2 * F.col("support") >= F.col("linked"), F.col("score")).otherwise(0.0)
        scored = edges.join(by_value.select("value", supported.alias("score")), "value", "left").select("value", "pattern", "seed", F.greatest("seed", F.coalesce("score", F.lit(0.0))).alias("score"))
    return scratch.table(by_value.where((F.col("s") == 0) & (F.col("score") >= GOOD_INSTANCE) & (2 * F.col("support") >= F.col("linked"))).select("value"))


def find(df: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans, for each row of df (doc_id, text)."""
    scratch = Scratch(df.sparkSession)
    own = tokens_of(base_spans(df))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    narrow = F.transform("base", lambda s: s.dropFields("value"))
    own = scratch.table(own.select("doc_id", "tk", *counts, narrow.alias("base"), "tokens"))  # texts are searched once
    tokens = own.where(F.size("tokens") > 0).select("doc_id", "tk", F.explode("tokens").alias("t")).select("doc_id", "tk", "t.*")
    found = good_instances(tokens, scratch)
    extra = tokens.where(~F.col("seed")).join(found, "value", "left_semi")
    extra = scratch.table(extra.groupBy(F.col("doc_id").alias("id"), F.col("tk").alias("key")).agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("k"), "end")).alias("extra")))
    names = F.array(*map(F.lit, [*KINDS, FOUND]))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.k + 1), s.start.cast("string"), s.end.cast("string"))), ",")
    rows = own.select("doc_id", "tk", *(f"n_{k}" for k in KINDS), "base", F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"))
    rows = rows.join(extra, F.expr("doc_id <=> id and tk = key"), "left")
    every = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(extra.schema["extra"].dataType))))
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", said(every).alias("spans"))
