"""``embed``, ``prompt`` and ``prompt_jev``: column functions that call a model, each distinct input once per batch.

A backend is any picklable object with the methods below; the stand-ins here are deterministic and need no network.
Functions are marked nondeterministic, so that the optimizer neither folds nor repeats them. ``distinct_first`` asks for
each distinct input once over the whole frame, by a join, which is the way for large frames.
"""

from __future__ import annotations

import hashlib
import json
import re
import threading
from collections import OrderedDict
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from ..session import bounded
from .questions import Question, read_literal, result_type

TEXTS_A_CALL, TEXT_CHARS, CACHED, CONCURRENT, ANSWERS_CACHED, ATTEMPTS = 256, 24_000, 4096, 8, 50_000, 5
RETRIED = (429, 529)


class Unavailable(RuntimeError):
    """The backend can't answer now; status as in HTTP. The value is null."""

    def __init__(self, status: int = 503):
        super().__init__(f"status {status}")
        self.status = status


class Rejected(RuntimeError):
    """The backend won't take this question; the query fails."""


class HashedWords:
    """Stand-in embedder: each word adds to one of a few components."""

    def __init__(self, width: int = 16):
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.width
            for w in re.findall(r"\w+", text.lower()):
                v[int(hashlib.md5(w.encode()).hexdigest(), 16) % self.width] += 1.0
            out.append(v)
        return out


class Echo:
    """Stand-in for prompts: the upper-cased prompt, shortened; and the first option whose name the state holds."""

    def complete(self, prompt: str, options: dict) -> str | None:
        return prompt.upper()[: int(options.get("length", 60))]

    def decide(self, state: str, question: Question) -> dict:
        if question.kind == "choice":
            named = [o for o in question.options if o.lower() in state.lower()]
            return question.answer(label=(named or question.options)[0], confidence=0.9 if named else 0.4)
        if question.kind == "score":
            return question.answer(value=min(len(state) / 1000, 1.0) * (len(question.options) - 1), confidence=0.8)
        return question.answer(value=1.0 if any(w in state.lower() for w in question.ask.lower().split()) else 0.0)


class Cache:
    """The last so many answers of this process."""

    def __init__(self, size: int):
        self.size, self.held, self.lock = size, OrderedDict(), threading.Lock()

    def __getstate__(self):
        return {"size": self.size}

    def __setstate__(self, state):
        self.__init__(state["size"])

    def get(self, key):
        with self.lock:
            if key in self.held:
                self.held.move_to_end(key)
                return True, self.held[key]
        return False, None

    def put(self, key, value):
        with self.lock:
            self.held[key] = value
            while len(self.held) > self.size:
                self.held.popitem(last=False)


def retried(call, pause=0.2, sleep=None):
    """Up to five attempts with doubling pauses while the backend is busy or broken."""
    import time

    for n in range(ATTEMPTS):
        try:
            return call()
        except Unavailable as e:
            if n + 1 == ATTEMPTS or not (e.status in RETRIED or e.status >= 500):
                raise
            (sleep or time.sleep)(pause * 2**n)


def digest(text: str) -> bytes:
    """What a cache keeps of a text, which may be long."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def bounded_here() -> None:
    if spark := SparkSession.getActiveSession():
        bounded(spark)


def embed_function(backend):
    """A column function text -> array<float>; null stays null, texts are cut at 24,000 characters."""
    cache = Cache(CACHED)
    bounded_here()

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(text: pd.Series) -> pd.Series:
        cut = text.where(text.isna(), text.str.slice(0, TEXT_CHARS))
        known = {}
        for t in cut.dropna().unique():
            there, value = cache.get(digest(t))
            if there:
                known[t] = value
        todo = [t for t in cut.dropna().unique() if t not in known]
        for at in range(0, len(todo), TEXTS_A_CALL):
            part = todo[at : at + TEXTS_A_CALL]
            for t, v in zip(part, retried(lambda part=part: backend.embed(part)), strict=True):
                known[t] = v
                cache.put(digest(t), v)
        return cut.map(lambda t: known.get(t) if isinstance(t, str) else None)

    return embed.asNondeterministic()


def prompt_options(text: str | None) -> dict:
    options = json.loads(text) if text else {}
    if not isinstance(options, dict) or (odd := set(options) - {"model", "effort", "schema", "length"}):
        raise Refused(f"options are an object of model, effort and schema, not {sorted(odd) if isinstance(options, dict) else options}")
    return options


def _collapsed(values: pd.Series, call, what: str) -> pd.Series:
    """Answers of distinct values, a few at a time; some failures are null, all failures an error."""
    unique = list(values.dropna().unique())
    failed = []

    def one(v):
        try:
            return retried(lambda: call(v))
        except Unavailable as e:
            failed.append(e)
            return None

    with ThreadPoolExecutor(CONCURRENT) as pool:
        known = dict(zip(unique, pool.map(one, unique), strict=True))
    if unique and len(failed) == len(unique):
        raise RuntimeError(f"every {what} failed: {failed[0]}")
    return values.map(lambda v: known.get(v) if isinstance(v, str) else None)


def prompt_function(backend, options: str | None = None):
    """A column function prompt -> answer. The options are constant in a query."""
    chosen = prompt_options(options)
    bounded_here()

    @F.pandas_udf(T.StringType())
    def prompt(text: pd.Series) -> pd.Series:
        return _collapsed(text, lambda t: backend.complete(t, chosen), "prompt")

    return prompt.asNondeterministic()


def decide_function(backend, question: str | dict[str, Question] | Question):
    """A column function state -> answer struct, typed by the question; unavailable: null, rejected: the query fails."""
    asked = read_literal(question) if isinstance(question, str) else question
    made, cache = result_type(asked), Cache(ANSWERS_CACHED)
    bounded_here()

    def answer(state):
        there, value = cache.get(digest(state))
        if there:
            return value
        try:
            value = retried(lambda: backend.decide(state, asked) if isinstance(asked, Question) else {k: backend.decide(state, q) for k, q in asked.items()})
        except Unavailable:
            return None
        cache.put(digest(state), value)
        return value

    @F.pandas_udf(made)
    def decide(state: pd.Series) -> pd.DataFrame:
        known = {s: answer(s) for s in state.dropna().unique()}
        rows = [known.get(s) if isinstance(s, str) else None for s in state]
        names = made.names
        return pd.DataFrame([[None] * len(names) if r is None else [r[n] for n in names] for r in rows], columns=names)

    return decide.asNondeterministic()


def distinct_first(df: DataFrame, column: str, function, out: str) -> DataFrame:
    """df with ``out`` = function(column), called once for each distinct value of the whole frame."""
    answers = df.select(F.col(column).alias("_tm_in")).where("_tm_in is not null").distinct().withColumn(out, function(F.col("_tm_in")))
    return df.join(answers, F.col(column) == F.col("_tm_in"), "left").drop("_tm_in")


#: A call of a model function whose second argument must be a literal, in SQL text.
CALL = re.compile(r"\b(prompt_jev|prompt|cosine_distance)\s*\(", re.I)


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of a call from the character after its bracket, and the place after its end."""
    parts, depth, start, quote, i = [], 0, at, None, at
    while i < len(text):
        c = text[i]
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c == "]" or (c == ")" and depth):
            depth -= 1
        elif c == "," and not depth:
            parts.append(text[start:i].strip())
            start = i + 1
        elif c == ")":
            return [*parts, text[start:i].strip()], i + 1
        i += 1
    raise Refused("a call doesn't end")


class SqlFunctions:
    """Registers the model functions, cosine_distance and the dialect's names in a session, and rewrites calls whose
    result type depends on a literal. Made for the ``functions`` argument of ``plans.sql``."""

    def __init__(self, embedder=None, model=None):
        self.embedder, self.model = embedder or HashedWords(), model or Echo()

    def __call__(self, spark: SparkSession, text: str) -> str:
        from . import dialect, vector

        bounded(spark)
        spark.udf.register("embed", embed_function(self.embedder))
        vector.register_cosine(spark)
        spark.udf.register("tm_cosine", vector.cosine_function())
        dialect.register(spark)
        return self.rewritten(spark, dialect.renamed(text))

    def rewritten(self, spark: SparkSession, text: str) -> str:
        from . import vector

        out, at = [], 0
        for m in CALL.finditer(text):
            if m.start() < at:
                continue
            given, end = _arguments(text, m.end())
            kind = m[1].lower()
            if kind == "cosine_distance":
                # SQL functions can't stand in every clause: of plain columns it is written out, and other arguments are evaluated once
                if len(given) == 2 and not any("(" in g for g in given):
                    out += [text[at : m.start()], f"({vector.COSINE_SQL.format(a=given[0], b=given[1])})"]
                else:
                    out += [text[at : m.start()], f"tm_cosine({', '.join(self.rewritten(spark, g) for g in given)})"]
                at = end
                continue
            if kind == "prompt_jev" and len(given) != 2 or kind == "prompt" and len(given) not in (1, 2):
                raise Refused(f"{kind} doesn't take {len(given)} arguments")
            literal = given[1] if len(given) == 2 else None
            if literal is not None and not re.fullmatch(r"'(?:[^']|'')*'", literal):
                raise Refused(f"the second argument of {kind} is a literal")
            value = literal[1:-1].replace("''", "'") if literal else None
            name = f"tm_{kind}_{hashlib.md5((value or '').encode()).hexdigest()[:12]}"
            spark.udf.register(name, decide_function(self.model, value) if kind == "prompt_jev" else prompt_function(self.model, value))
            out += [text[at : m.start()], f"{name}({self.rewritten(spark, given[0])})"]
            at = end
        return "".join([*out, text[at:]])


def match_terms(text: Column, terms: str) -> Column:
    """An extension: whether a text holds any of the words."""
    from ..operators.text import words

    return F.arrays_overlap(words(text), F.array(*[F.lit(w) for w in sorted(set(re.findall(r"\w+", terms.lower())))]))
