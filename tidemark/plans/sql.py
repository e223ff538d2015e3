"""Read-only SQL over snapshots: an allow-list of plan nodes, one snapshot per table, limits on text, time and result."""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import Missing, Refused
from ..schema import visible
from ..sources.tables import Catalog

TEXT_BYTES, SECONDS, RESULT_BYTES = 64 << 10, 60, 8 << 20
#: Root nodes of parsed statements that only read.
READS = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "LimitAll", "Offset", "Distinct", "Deduplicate", "Union", "Intersect", "Except", "UnresolvedWith", "WithWindowDefinition", "UnresolvedHaving", "UnresolvedInlineTable",
    "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "Join", "LateralJoin", "Generate", "Expand", "Pivot", "Unpivot", "UnresolvedRelation", "UnresolvedTableValuedFunction", "OneRowRelation", "Window", "Sample", "UnresolvedTVFAliases", "LocalRelation", "ResolvedInlineTable", "UnresolvedHint",
}


def parse(spark: SparkSession, text: str):
    if len(text.encode()) > TEXT_BYTES:
        raise Refused(f"a statement has at most {TEXT_BYTES} bytes")
    # the parser goes by the settings of the thread's active session
    kind = spark._get_j_spark_session_class(spark._jvm)
    before = kind.getActiveSession()
    kind.setActiveSession(spark._jsparkSession)
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    finally:
        kind.setActiveSession(before.get()) if before.isDefined() else kind.clearActiveSession()


def _children(plan) -> list:
    found, every = [], plan.children()
    for i in range(every.size()):
        found.append(every.apply(i))
    inner = plan.innerChildren()
    for i in range(inner.size()):
        found.append(inner.apply(i))
    return found


def guard(spark: SparkSession, text: str) -> None:
    """Refuse what isn't a query. EXPLAIN of a query may pass, since statements are rehearsed by it."""
    plan = parse(spark, text)
    kind = plan.getClass().getSimpleName()
    if kind == "ExplainCommand":
        plan = plan.logicalPlan()
        kind = plan.getClass().getSimpleName()
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind not in READS:
            raise Refused(f"only queries are taken, not {kind}")
        todo += [c for c in _children(node) if "logical" in c.getClass().getName() or "analysis" in c.getClass().getName()]


def referenced(spark: SparkSession, text: str) -> list[str]:
    """Tables that a statement names, in any query of it; CTEs don't count. Case is kept."""
    import re

    plan = parse(spark, text)
    said = plan.toString()
    names = re.findall(r"'UnresolvedRelation \[([^\]]+)\]", said)
    ctes = {m for m in re.findall(r"(?m)CTE \[([^\]]*)\]", said) for m in re.split(r",\s*", m)}
    return list(dict.fromkeys(n for n in names if n not in ctes))


def prepare(catalog: Catalog, text: str, functions=None, rebound: dict[str, DataFrame] | None = None) -> DataFrame:
    """The statement's plan over one snapshot of each table it names; hidden columns may be used but don't come out.

    rebound: frames that stand in for tables. functions: registers what the statement calls, and may rewrite it.
    """
    spark = catalog.spark
    known, rebound = set(catalog.names()), rebound or {}
    own = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold"):
        own.conf.set(k, spark.conf.get(k))  # what the caller's session was tuned to
    for k, v in (("spark.sql.ansi.doubleQuotedIdentifiers", "true"), ("spark.sql.session.timeZone", "UTC")):
        own.conf.set(k, v)
    guard(own, text)
    if functions is not None:
        text = functions(own, text)
    for name in referenced(own, text):
        frame = rebound.get(name)
        if frame is None:
            if name not in known:
                raise Missing(f"no table {name}")
            frame = catalog.table(name).frame()
        DataFrame(frame._jdf, spark).createOrReplaceGlobalTempView(view := f"tm_{uuid.uuid4().hex}")
        try:
            own.sql(f"SELECT * FROM global_temp.{view}").createOrReplaceTempView(f"`{name}`")
        finally:
            spark.catalog.dropGlobalTempView(view)
    return visible(own.sql(text))


def limited(spark: SparkSession, action, seconds: float = SECONDS):
    """Run an action to its end; its jobs are cancelled after so long, and it is refused then."""
    tag, over = f"tm-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        over.set()
        spark.interruptTag(tag)

    spark.addTag(tag)
    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return action(over)
    except Exception as e:
        if over.is_set() and not isinstance(e, Refused):
            raise Refused(f"the statement took more than {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)


def query(catalog: Catalog, text: str, functions=None, seconds: float = SECONDS, most: int = RESULT_BYTES) -> list[dict]:
    """Rows of a statement as JSON values, refused beyond so many bytes."""
    df = prepare(catalog, text, functions)

    def rows(over: threading.Event) -> list[dict]:
        out, size = [], 2
        for row in df.toJSON().toLocalIterator():
            if over.is_set():
                raise Refused(f"the statement took more than {seconds} seconds")
            size += len(row.encode()) + 1
            if size > most:
                raise Refused(f"the result has more than {most} bytes")
            out.append(json.loads(row))
        return out

    return limited(df.sparkSession, rows, seconds)
