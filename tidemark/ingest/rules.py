"""What is decided about a source's records: the table they go to, its columns, and how both change.

Facts come from one aggregation over all records; decisions are made on the driver over at most a few hundred fields.
A judge, if there is one, answers typed questions; what it isn't sure of falls to the safe default.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.questions import Question
from .literals import KEYABLE, KINDS, candidates, convert, fits, lossless
from .literals import parts as literals_parts

ID, EXTRA, BRONZE, QUARANTINE = "record_id", "extra", "ingest_bronze", "ingest_quarantine"
SURE, MANY_FIELDS, MAX_COLUMNS, KEY_RECORDS, OVERLAP, HISTORY = 0.6, 24, 200, 5, 0.6, 200
#: Fields whose one value names the kind of record. Fixed values.
NAMING = ("type", "kind", "event", "event_type", "object", "entity", "resource")
NONE, NEW = "none", "new"


class Judge(Protocol):
    def ask(self, state: dict, questions: dict[str, Question]) -> dict[str, dict]:
        """Answers by name, as ``Question.answer`` gives them; what is missing is undecided."""


class NoJudge:
    def ask(self, state, questions):
        return {}


@dataclass
class Change:
    what: str
    chose: str
    by: str = "rule"
    confidence: float | None = None


@dataclass
class RuleColumn:
    name: str
    kind: str
    required: bool = False
    aliases: list[str] = field(default_factory=list)

    def value(self, fields: Column | None = None) -> Column:
        """The record's literal for this column: under its name, else the first alias that is there."""
        held = F.col("fields") if fields is None else fields
        return F.coalesce(*[held[F.lit(n)] for n in (self.name, *self.aliases)])


@dataclass
class Rule:
    table: str
    columns: list[RuleColumn] = field(default_factory=list)
    primary_key: str | None = None
    keys_are_data: bool = False
    sources: list[str] = field(default_factory=list)
    history: list[Change] = field(default_factory=list)
    embeddings: list[str] = field(default_factory=list)
    considered: list[str] = field(default_factory=list)
    version: int = 0

    def column(self, name: str) -> RuleColumn | None:
        return next((c for c in self.columns if name == c.name or name in c.aliases), None)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Rule:
        return cls(**{**d, "columns": [RuleColumn(**c) for c in d["columns"]], "history": [Change(**c) for c in d["history"]]})


def valid_source(name: str) -> bool:
    return re.fullmatch(r"[A-Za-z0-9._-]{1,128}", name) is not None


def column_name(key: str) -> bool:
    """Whether a field's name can be a column as it is; other fields stay in the catch-all, never renamed."""
    return 0 < len(key.encode()) <= 64 and not key.startswith("_") and key not in (ID, EXTRA) and all(ord(c) >= 32 and not 127 <= ord(c) < 160 for c in key)


def table_name(text: str) -> str | None:
    """A table's name made of what a client sent."""
    name = re.sub(r"[^a-z0-9]+", "_", re.sub(r"[A-Z]", lambda m: m[0].lower(), text)).strip("_")
    return (f"t_{name}" if name[:1].isdigit() else name)[:48] or None


def alike(a: str, b: str) -> bool:
    """The same name in another case convention."""
    fold = lambda s: "".join(c for c in s if c.isalnum()).lower()
    return a != b and fold(a) == fold(b) != ""


def profile(records: DataFrame, most: int = 4 * MAX_COLUMNS) -> dict[str, dict]:
    """By field: in how many records it is, is filled, is nested, fits each kind, its distinct values, and a few of them.

    Beyond ``most`` fields names are data, and the rest needs no look. records has fields; all of them are counted.
    """
    each = records.select(F.explode("fields").alias("key", "v"))
    v = F.col("v")
    each = each.withColumns(parts := literals_parts(v))
    known = {k: F.col(k) for k in parts}
    filled = v["kind"] != "null"
    count = lambda c, name: F.count_if(c).alias(name)
    facts = [F.count("*").alias("present"), count(filled, "filled"), count(v["kind"].isin("object", "array"), "nested"), F.approx_count_distinct(F.sha2(v["json"], 256)).alias("distinct_about"), F.min(F.when(v["kind"] == "text", v["text"])).alias("low"), F.max(F.when(v["kind"] == "text", v["text"])).alias("high"), count(v["kind"] == "text", "texts")]
    facts += [count(fits(k, v, known), f"fit_{k}") for k in KINDS]
    # least and greatest texts alone would have all values of all records sorted by field; with a set beside them they are hashed
    by_hash = F.collect_set(F.lit(True)).alias("_by_hash")
    found = each.groupBy("key").agg(*facts, by_hash).orderBy(F.desc("present"), "key").limit(most).collect()
    return {r["key"]: {k: x for k, x in r.asDict().items() if k != "_by_hash"} for r in found}


def unique(records: DataFrame, keys: list[str]) -> list[str]:
    """Of some fields, those whose values all differ. One exact aggregation for each."""
    out = []
    for k in keys:
        again = records.groupBy(F.sha2(F.col("fields")[F.lit(k)]["json"], 256)).count().where("count > 1")
        if again.isEmpty():
            out.append(k)
    return out


def sure(answers: dict, key: str) -> tuple[str | float, float] | None:
    """A label, or a yes/no as its degree, that the judge is sure enough of."""
    a = answers.get(key)
    if not a or (a.get("confidence") or 0) < SURE:
        return None
    said = a["answer"] if a.get("answer") is not None else a.get("value")
    return None if said is None else (said, a["confidence"])


def pick_kind(key: str, options: list[str], answers: dict, question: str, changes: list[Change]) -> str:
    if len(options) == 1:
        return options[0]
    said = sure(answers, question)
    if said and said[0] in options:
        changes.append(Change(f"type of {key}", said[0], "judge", said[1]))
        return said[0]
    changes.append(Change(f"type of {key}", kind := lossless(options)))
    return kind


def matching(rules: list[Rule], facts: dict[str, dict], records: DataFrame) -> list[Rule]:
    """Tables that hold most of these fields and that every value fits."""
    out = []
    for rule in rules:
        known = {f: c for f in facts if (c := rule.column(f))}
        if rule.keys_are_data or not facts or len(known) < OVERLAP * len(facts):
            continue
        if all(facts[f]["filled"] == facts[f][f"fit_{c.kind}"] for f, c in known.items()):
            out.append(rule)
    return out


def design(source: str, records: DataFrame, facts: dict[str, dict], total: int, taken: set[str], judge: Judge) -> tuple[Rule, list[Change]]:
    """A rule for records that no table holds yet."""
    changes: list[Change] = []
    bases = [table_name(source)]
    for key in NAMING:
        f = facts.get(key)
        if f and f["texts"] == total and f["present"] == total and f["low"] == f["high"]:
            bases.append(table_name(f["low"]))
    names: list[str] = []
    for base in [b for b in bases if b] or ["ingested"]:
        name, n = base, 2
        while name in taken or name in (BRONZE, QUARANTINE):
            name, n = f"{base}_{n}", n + 1
        if name not in names:
            names.append(name)
    named = [k for k in facts if column_name(k)]
    over = len(named) + 2 > MAX_COLUMNS
    asked: dict[str, Question] = {}
    if len(names) > 1:
        asked["name"] = Question("choice", "What is the table of these records called?", names)
    if len(named) >= MANY_FIELDS:
        asked["keys_are_data"] = Question("noul", "Are the names of the fields themselves data?")
    options = {k: candidates(facts[k]) for k in named}
    keys: list[str] = []
    if not over:
        for k in named:
            if len(options[k]) > 1:
                asked[f"type:{k}"] = Question("choice", f"What is {k}?", options[k])
            if facts[k]["present"] == total:
                asked[f"required:{k}"] = Question("noul", f"Is a record without {k} broken?")
        maybe = [k for k in named if total >= KEY_RECORDS and facts[k]["filled"] == total and any(o in KEYABLE for o in options[k]) and facts[k]["distinct_about"] >= 0.8 * total]
        keys = [] if isinstance(judge, NoJudge) else unique(records, maybe)
        if keys:
            asked["key"] = Question("choice", "Which field identifies a record?", [*keys, NONE])
    answers = judge.ask({"source": source, "fields": facts}, asked) if asked else {}

    said = sure(answers, "name")
    table = said[0] if said and said[0] in names else names[0]
    changes.append(Change("table name", table, "judge", said[1]) if said and said[0] in names else Change("table name", table))
    if said := sure(answers, "keys_are_data"):
        changes.append(Change("keys are data", str(said[0] >= 0.5).lower(), "judge", said[1]))
    elif over:
        changes.append(Change("keys are data", "true"))
    rule = Rule(table, keys_are_data=over or bool(said and said[0] >= 0.5), sources=[source])
    if not rule.keys_are_data:
        for k in named:
            kind = pick_kind(k, options[k], answers, f"type:{k}", changes)
            need = sure(answers, f"required:{k}")
            if need:
                changes.append(Change(f"{k} required", str(need[0] >= 0.5).lower(), "judge", need[1]))
            rule.columns.append(RuleColumn(k, kind, bool(need and need[0] >= 0.5)))
    said = sure(answers, "key")
    if said and said[0] in keys and (column := rule.column(said[0])):
        rule.primary_key = said[0]
        changes.append(Change("primary key", said[0], "judge", said[1]))
        column.required = True
        if column.kind not in KEYABLE:
            column.kind = next(o for o in options[said[0]] if o in KEYABLE)
    else:
        changes.append(Change("primary key", ID))
    return rule, changes


def key_refusal(rule: Rule) -> Column:
    """Why a record can't be placed, or null."""
    column = rule.column(rule.primary_key) if rule.primary_key else None
    if column is None:
        return F.lit(None).cast("string")
    value = column.value()
    missing = F.lit(f'missing its key "{column.name}"')
    wrong = F.lit(f'its key "{column.name}" is not a {column.kind}')
    return F.when(value.isNull() | (value["kind"] == "null"), missing).when(~fits(column.kind, value), wrong)


def evolve(rule: Rule, records: DataFrame, judge: Judge) -> tuple[list[Change], bool, Column]:
    """Let a table's rule follow new records: renames, then the key, then new columns, gaps and misfits.

    Gives the changes, whether the table must be made again, and a column with the reason to refuse a record (or null).
    """
    changes: list[Change] = []
    if rule.keys_are_data:
        return changes, False, key_refusal(rule)
    reshaped = False
    facts = profile(records)
    unknown = [k for k in facts if column_name(k) and rule.column(k) is None]

    # renames: a column that no record with the new field has, and whose kind takes the field's values
    asked: dict[str, Question] = {}
    if len(unknown) >= MANY_FIELDS:
        asked["keys_are_data"] = Question("noul", "Are the names of the new fields themselves data?")
    pairs = [(k, c) for k in unknown for c in rule.columns if facts[k][f"fit_{c.kind}"] == (facts[k]["present"] if c.name == rule.primary_key else facts[k]["filled"])] if len(unknown) <= MAX_COLUMNS else []
    could: dict[str, list[RuleColumn]] = {}
    if pairs:
        both = [F.count_if(F.col("fields")[F.lit(k)].isNotNull() & c.value().isNotNull()).alias(f"p{i}") for i, (k, c) in enumerate(pairs)]
        met = records.agg(*both).first()
        for i, (k, c) in enumerate(pairs):
            if not met[f"p{i}"]:
                could.setdefault(k, []).append(c)
    spelled = {k: next(c for c in cs if alike(k, c.name)) for k, cs in could.items() if any(alike(k, c.name) for c in cs)}
    for k, cs in could.items():
        if k not in spelled:
            asked[f"rename:{k}"] = Question("choice", f"Is {k} one of these columns under a new name?", [*(c.name for c in cs), NEW + " field"])
    answers = judge.ask({"rule": rule.to_dict(), "fields": facts}, asked) if asked else {}
    if said := sure(answers, "keys_are_data"):
        changes.append(Change("keys are data", str(said[0] >= 0.5).lower(), "judge", said[1]))
        rule.keys_are_data = said[0] >= 0.5
    if not rule.keys_are_data:
        for k, c in spelled.items():
            c.aliases.append(k)
            changes.append(Change(f"{k} is {c.name} renamed", "true"))
            reshaped = True
        # a lean is enough: a missed rename splits a field, a missed key refuses every record. The surer field has the column.
        leans = [(a.get("confidence") or 0, k, a["answer"]) for k in could if (a := answers.get(f"rename:{k}")) and a.get("answer")]
        done: set[str] = set()
        for confidence, k, name in sorted(leans, key=lambda x: -x[0]):
            c = next((c for c in could[k] if c.name == name), None)
            if c is None:
                changes.append(Change(f"{k} is a new field", "true", "judge", confidence))
            elif c.name not in done:
                done.add(c.name)
                c.aliases.append(k)
                changes.append(Change(f"{k} is {c.name} renamed", "true", "judge", confidence))
                reshaped = True

    refuse = key_refusal(rule)
    live = records.where(refuse.isNull())
    if rule.keys_are_data or live.isEmpty():
        return changes, reshaped, refuse

    facts = profile(live)
    fresh = [k for k in facts if column_name(k) and rule.column(k) is None]
    options = {k: candidates(facts[k]) for k in fresh}
    seen = {}
    values = []
    for i, c in enumerate(rule.columns):
        v = c.value()
        values += [F.count_if(v.isNull() | (v["kind"] == "null")).alias(f"gap{i}"), F.count_if(v["kind"] != "null").alias(f"filled{i}"), F.count_if(v["kind"].isin("object", "array")).alias(f"nested{i}")]
        values += [F.count_if(fits(k, v)).alias(f"fit_{k}{i}") for k in KINDS]
    counts = live.agg(*values).first().asDict() if values else {}
    for i, c in enumerate(rule.columns):
        seen[c.name] = {k: counts[f"{k}{i}"] for k in ("gap", "filled", "nested", *(f"fit_{k}" for k in KINDS))}
    gaps = [c for c in rule.columns if c.required and c.name != rule.primary_key and seen[c.name]["gap"]]
    misfits = {c.name: [k for k in candidates(seen[c.name]) if k != c.kind and (c.name != rule.primary_key or k in KEYABLE)] for c in rule.columns if seen[c.name][f"fit_{c.kind}"] < seen[c.name]["filled"]}
    asked = {f"type:{k}": Question("choice", f"What is {k}?", o) for k, o in options.items() if len(o) > 1}
    asked |= {f"optional:{c.name}": Question("noul", f"Is {c.name} optional rather than these records broken?") for c in gaps}
    asked |= {f"widen:{n}": Question("choice", f"What becomes of {n}?", [*o, "keep"]) for n, o in misfits.items() if o}
    answers = judge.ask({"rule": rule.to_dict(), "fields": facts}, asked) if asked else {}
    for k in fresh:
        if len(rule.columns) + 2 >= MAX_COLUMNS:
            changes.append(Change(f"column {k}", "kept in the catch-all: the table is at its column limit"))
            continue
        kind = pick_kind(k, options[k], answers, f"type:{k}", changes)
        changes.append(Change(f"new column {k}", kind))
        rule.columns.append(RuleColumn(k, kind))
        reshaped = True
    for c in gaps:
        said = sure(answers, f"optional:{c.name}")
        if said and said[0] < 0.5:
            changes.append(Change(f"{c.name} missing", "refuse the records", "judge", said[1]))
            v = c.value()
            refuse = F.coalesce(refuse, F.when(v.isNull() | (v["kind"] == "null"), F.lit(f'missing the required field "{c.name}"')))
        else:
            c.required = False
            changes.append(Change(f"{c.name} missing", "now optional", *(("judge", said[1]) if said else ())))
    for n, wider in misfits.items():
        said = sure(answers, f"widen:{n}")
        if said and said[0] in wider:
            rule.column(n).kind = said[0]
            changes.append(Change(f"widen {n}", said[0], "judge", said[1]))
            reshaped = True
        else:
            changes.append(Change(f"widen {n}", "kept; values that do not fit are in the catch-all"))
    return changes, reshaped, refuse


def mapped(rule: Rule, records: DataFrame) -> DataFrame:
    """Typed rows of records (with id and fields): a value for each column, the id, and what is left over as JSON text."""
    out = [F.col("id").alias(ID)]
    for c in rule.columns:
        out.append(convert(c.kind, c.value()).alias(c.name))
    names = {n: (c, i) for c in rule.columns for i, n in enumerate((c.name, *c.aliases))}

    def stays(entry: Column) -> Column:
        known = F.lit(False)
        for n, (c, i) in names.items():
            first = F.lit(True)
            for earlier in (c.name, *c.aliases)[:i]:
                first = first & F.col("fields")[F.lit(earlier)].isNull()
            known = known | ((entry["key"] == n) & first & ((entry["value"]["kind"] == "null") | fits(c.kind, entry["value"])))
        return ~known

    rest = F.filter(F.map_entries("fields"), stays)
    text = F.concat(F.lit("{"), F.array_join(F.array_sort(F.transform(rest, lambda e: F.concat(e["value"]["name"], F.lit(":"), e["value"]["json"]))), ","), F.lit("}"))
    return records.select(*out, F.when(F.size(rest) > 0, text).alias(EXTRA))
