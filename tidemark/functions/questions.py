"""Typed questions: a choice, a score on ordered levels, or a yes/no with a degree; and how answers read."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..errors import Refused

ANSWER = T.StructType([T.StructField("answer", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("confidence", T.DoubleType())])


@dataclass
class Question:
    kind: str  # choice, score or noul
    ask: str
    options: list[str] = field(default_factory=list)

    def __post_init__(self):
        if self.kind not in ("choice", "score", "noul"):
            raise Refused(f"no such kind of question: {self.kind}")
        if self.kind == "choice" and not (2 <= len(self.options) <= 255 and all(o.strip() for o in self.options)):
            raise Refused("a choice has 2 to 255 options with names")
        if self.kind == "score" and len(self.options) < 2:
            raise Refused("a score has at least two levels")
        if self.kind == "noul" and not self.ask.strip():
            raise Refused("a yes/no question asks something")

    @classmethod
    def read(cls, data: dict) -> Question:
        if odd := set(data) - {"kind", "ask", "options", "levels"}:
            raise Refused(f"unknown fields {sorted(odd)}")
        return cls(data.get("kind", "choice"), data.get("ask", ""), list(data.get("options") or data.get("levels") or []))

    def answer(self, value: float | None = None, label: str | None = None, confidence: float | None = None) -> dict:
        """choice: label and confidence. score: the level nearest to the value. noul: the value, sure away from a half."""
        if self.kind == "choice":
            return {"answer": label, "value": None, "confidence": confidence}
        if self.kind == "score":
            at = min(max(int(value + 0.5), 0), len(self.options) - 1)
            return {"answer": self.options[at], "value": float(value), "confidence": confidence}
        return {"answer": None, "value": float(value), "confidence": abs(value - 0.5) * 2}


def parse_criteria(text: str) -> list[tuple[str, str]]:
    """``a=x; b=y`` as pairs."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        name, sep, value = part.partition("=")
        if not sep or not name.strip() or not value.strip():
            raise Refused(f"not name=text: {part!r}")
        out.append((name.strip(), value.strip()))
    return out


parse_levels = parse_criteria


def read_literal(text: str) -> dict[str, Question] | Question:
    """A question, or a set of them by name, from JSON."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise Refused(f"a question is JSON: {e}") from e
    if not isinstance(data, dict) or not data:
        raise Refused("a question is an object, or an object of them")
    if all(isinstance(v, dict) for v in data.values()):
        return {k: Question.read(v) for k, v in data.items()}
    return Question.read(data)


def result_type(question: dict[str, Question] | Question) -> T.StructType:
    return ANSWER if isinstance(question, Question) else T.StructType([T.StructField(k, ANSWER) for k in question])
