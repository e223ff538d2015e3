"""The engine's own operators as queries by name: keyed tables, search, model functions, ingest, views, schedules, phrases."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import Echo, HashedWords, SqlFunctions, decide_function, distinct_first, embed_function, match_terms, prompt_function
from ..functions.questions import Question
from ..functions.vector import DISTANCES
from ..ingest import literals
from ..ingest.engine import Ingest
from ..ingest.prose import prose
from ..ingest.rules import profile
from ..operators.joins import nearest_join
from ..operators.search import search
from ..operators.text import words
from ..sources.files import scratch_root
from ..sources.tables import Catalog, Table
from ..streaming.schedule import Cron, Every
from ..streaming.views import View, Views
from . import sql
from .language import values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def catalog(spark: SparkSession) -> Catalog:
    return Catalog(spark, scratch_root(spark))


def events_by_user(spark: SparkSession, sf: str, compact: bool = False) -> Table:
    """Events keyed by user, which arrive by event_id in two appends."""
    events = load(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    half = events.agg(F.expr("percentile_approx(event_id, 0.5, 1000)")).first()[0]
    table = catalog(spark).create("events", events.where(F.col("event_id") <= half).orderBy("event_id"), ["user_id"])
    table.append(events.where(F.col("event_id") > half).orderBy("event_id"))
    if compact:
        table.compact()
    return table


NEWEST = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1"


# keyed tables
@query(NEWEST)
def keyed_newest_wins(spark, sf):
    return events_by_user(spark, sf).snapshot()


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1")
def keyed_composite_pk(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").orderBy("l_partkey", "l_quantity")
    return catalog(spark).create("lineitem", rows, ["l_orderkey", "l_linenumber"]).snapshot()


@query(f"SELECT * FROM ({NEWEST}) WHERE value > 50")
def keyed_filter_after_dedup(spark, sf):
    return events_by_user(spark, sf).snapshot().where("value > 50")


@query("SELECT n_name, n_regionkey FROM nation UNION SELECT upper(n_name), n_regionkey FROM nation")
def keyed_content_hash(spark, sf):
    rows = load(spark, sf, "nation").select("n_name", "n_regionkey")
    table = catalog(spark).create("nation", rows)
    table.append(rows)
    table.append(rows.withColumn("n_name", F.upper("n_name")))
    return table.snapshot()


@query(NEWEST)
def keyed_compaction(spark, sf):
    return events_by_user(spark, sf, compact=True).snapshot()


@query("SELECT n_nationkey, n_name FROM nation")
def keyed_snapshot_isolation(spark, sf):
    rows = load(spark, sf, "nation").select("n_nationkey", "n_name")
    table = catalog(spark).create("nation", rows, ["n_nationkey"])
    frozen = table.snapshot()
    table.append(rows.withColumn("n_name", F.lit("changed")))
    return frozen


@query(f"SELECT count(*) AS n FROM ({NEWEST}) WHERE event_type = 'click'")
def count_rows_predicate(spark, sf):
    return spark.createDataFrame([(events_by_user(spark, sf).count_rows("event_type = 'click'"),)], "n long")


@query(f"SELECT event_type, count(*) AS n FROM ({NEWEST}) GROUP BY event_type")
def keyed_sql(spark, sf):
    own = events_by_user(spark, sf).catalog
    return sql.prepare(own, 'SELECT event_type, count(*) AS n FROM "events" GROUP BY event_type')


@query("SELECT 3 AS version, 2 * count(*) AS rows FROM nation")
def table_describe(spark, sf):
    rows = load(spark, sf, "nation")
    table = catalog(spark).create("nation", rows, ["n_nationkey"])
    table.append(rows)
    return spark.createDataFrame([(table.describe()["version"], sum(g["rows"] for g in table.stats()))], "version int, rows long")


# search
def vectors(spark: SparkSession, sf: str, metric: str = "l2") -> Table:
    rows = load(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    own = catalog(spark)
    own.create("embeddings", rows, ["vec_id"], widths={"embedding": 64}).index_vector("embedding", metric)
    return own.table("embeddings")


def first_vector(spark: SparkSession, sf: str) -> list[float]:
    return list(load(spark, sf, "embeddings").where("vec_id = 0").first().embedding)


_V = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_DISTANCE = {"l2": "list_distance(embedding::DOUBLE[], q) ** 2", "cosine": "1 - list_cosine_similarity(embedding::DOUBLE[], q)", "dot": "1 - list_inner_product(embedding::DOUBLE[], q)"}


def knn(metric: str, where: str | None = None):
    def run(spark, sf):
        request = {"vector": first_vector(spark, sf), "k": 10, "columns": ["vec_id"], "filter": where}
        return search(vectors(spark, sf, metric), request).select("vec_id", (F.round("_distance", 4) + 0.0).alias("distance"))

    run.__name__ = f"knn_{metric}" if where is None else "knn_prefilter"
    condition = f"WHERE {where}" if where else ""
    return query(f"SELECT vec_id, round({_DISTANCE[metric]}, 4) + 0.0 AS distance FROM embeddings, {_V} {condition} ORDER BY {_DISTANCE[metric]}, vec_id LIMIT 10")(run)


for _metric in DISTANCES:
    knn(_metric)
knn("l2", "label = 1")


@query(ORACLES["knn_l2"])
def knn_ivf(spark, sf):
    """By the vector cells, with a later generation that supersedes half of the rows, and all cells read, so that it is exact."""
    rows = load(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    table = catalog(spark).create("embeddings", rows.withColumn("embedding", F.when(F.col("vec_id") % 2 == 0, F.reverse("embedding")).otherwise(F.col("embedding"))), ["vec_id"], widths={"embedding": 64})
    table.index_vector("embedding", "l2", cells=0)
    table.append(rows.where("vec_id % 2 = 0"))
    found = search(table, {"vector": first_vector(spark, sf), "k": 10, "columns": ["vec_id"], "nprobes": 1024})
    return found.select("vec_id", (F.round("_distance", 4) + 0.0).alias("distance"))


@query("""SELECT query_id, vec_id, round(d, 4) + 0.0 AS distance FROM (SELECT q.vec_id AS query_id, e.vec_id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2 AS d,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2, e.vec_id) AS turn
FROM embeddings q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0) WHERE turn = 1""")
def knn_join(spark, sf):
    """The nearest row of the same label for each query, the rows whose id is divisible by 20."""
    rows = vectors(spark, sf).snapshot()
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    return nearest_join(asked, rows).select("query_id", "vec_id", (F.round("d", 4) + 0.0).alias("distance"))


@query(f"SELECT vec_id FROM embeddings, {_V} WHERE vec_id <> 0 ORDER BY {_DISTANCE['cosine']}, vec_id LIMIT 10")
def sql_cosine_distance(spark, sf):
    own = vectors(spark, sf).catalog
    text = "SELECT e.vec_id FROM embeddings e, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) WHERE e.vec_id <> 0 ORDER BY cosine_distance(e.embedding, q), e.vec_id LIMIT 10"
    return sql.prepare(own, text, SqlFunctions())


@query("SELECT vec_id, label FROM embeddings WHERE label > 2 ORDER BY vec_id LIMIT 15 OFFSET 5")
def search_filter_page(spark, sf):
    rows = load(spark, sf, "embeddings").select("vec_id", "label").orderBy("vec_id").coalesce(1)
    return search(catalog(spark).create("e", rows, ["vec_id"]), {"filter": "label > 2", "columns": ["vec_id", "label"], "k": 15, "offset": 5})


def texts(spark: SparkSession, sf: str) -> Table:
    own = catalog(spark)
    own.create("documents", load(spark, sf, "documents").select("doc_id", "text", "lang", "source"), ["doc_id"]).index_text("text")
    return own.table("documents")


_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"


@query(f"SELECT doc_id FROM documents WHERE list_has_any({_TOKENS}, ['worthless', 'password'])")
def fts_terms(spark, sf):
    return search(texts(spark, sf), {"full_text": "worthless PASSWORD", "columns": ["doc_id"], "k": 1 << 31 - 1}).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE lang = 'en' AND list_has_any({_TOKENS}, ['the'])")
def fts_with_filter(spark, sf):
    return search(texts(spark, sf), {"full_text": {"query": "the", "columns": ["text"]}, "filter": "lang = 'en'", "columns": ["doc_id"], "k": 1 << 31 - 1}).select("doc_id")


@query(f"""WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents), n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d),
t AS (SELECT doc_id, len(w) AS len, unnest(['that', 'worthless']) AS term, w FROM d), f AS (SELECT doc_id, len, term, len(list_filter(w, lambda x: x = term)) AS tf FROM t),
g AS (SELECT term, count(*) AS df FROM f WHERE tf > 0 GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
FROM f JOIN g USING (term), n WHERE tf > 0 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def fts_bm25_topk(spark, sf):
    found = search(texts(spark, sf), {"full_text": "that worthless", "columns": ["doc_id"], "k": 60})
    return found.select("doc_id", F.round("_score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query(ORACLES["fts_bm25_topk"])
def fts_indexed(spark, sf):
    """The same over two generations, of which the later supersedes every other text."""
    rows = load(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    own = catalog(spark)
    own.create("documents", rows.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("worthless, worthless")).otherwise(F.col("text"))), ["doc_id"]).index_text("text")
    own.table("documents").append(rows.where("doc_id % 2 = 0"))
    found = search(own.table("documents"), {"full_text": "that worthless", "columns": ["doc_id"], "k": 60})
    return found.select("doc_id", F.round("_score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query(f"SELECT doc_id, list_has_any({_TOKENS}, ['license', 'secret']) AS hit FROM documents")
def match_terms_extension(spark, sf):
    return load(spark, sf, "documents").select("doc_id", match_terms(F.col("text"), "license secret").alias("hit"))


# model functions, with deterministic stand-ins
@query()
def embed_hash(spark, sf):
    return load(spark, sf, "documents").select("doc_id", embed_function(HashedWords())(F.col("text")).alias("v"))


@query("SELECT conv_id, turn, upper(role)[:60] AS answer FROM conversations")
def prompt_distinct(spark, sf):
    return distinct_first(load(spark, sf, "conversations").select("conv_id", "turn", "role"), "role", prompt_function(Echo()), "answer").drop("role")


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'password') THEN 'password' WHEN contains(lower(text), 'the') THEN 'the' ELSE 'password' END AS label FROM documents WHERE text IS NOT NULL")
def decide_choice(spark, sf):
    ask = decide_function(Echo(), Question("choice", "which?", ["password", "the"]))
    return load(spark, sf, "documents").where("text is not null").select("doc_id", ask(F.col("text"))["answer"].alias("label"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1.0 ELSE 0.0 END::DOUBLE AS mine, 1.0::DOUBLE AS sure FROM conversations WHERE role IS NOT NULL")
def decide_set(spark, sf):
    ask = '{"mine": {"kind": "noul", "ask": "user"}, "who": {"kind": "choice", "options": ["user", "assistant"]}}'
    own = catalog(spark)
    own.create("conversations", load(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    return sql.prepare(own, f"SELECT conv_id, turn, d['mine']['value'] AS mine, d['mine']['confidence'] AS sure FROM (SELECT *, prompt_jev(role, '{ask}') AS d FROM conversations WHERE role IS NOT NULL)", SqlFunctions())


# ingest
def records(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    return events.select("event_id", F.to_json(F.struct("event_id", "user_id", "event_type", F.col("value").cast("decimal(12,2)").alias("value"), F.col("props").alias("_props"))).alias("record")).orderBy("event_id").select("record")


@query("SELECT event_id, user_id, event_type, CAST(value AS DECIMAL(12,2))::DOUBLE AS value FROM events")
def ingest_typed(spark, sf):
    into = Ingest(catalog(spark))
    into.frame("feed", records(spark, sf))
    return into.catalog.table("feed").snapshot().select("event_id", "user_id", "event_type", F.col("value").cast("double").alias("value"))


@query("SELECT event_id, props FROM events")
def ingest_catch_all(spark, sf):
    into = Ingest(catalog(spark))
    into.frame("feed", records(spark, sf))
    return into.catalog.table("feed").snapshot().select("event_id", F.get_json_object("extra", "$._props").alias("props"))


@query("SELECT 'not a JSON object' AS reason, count(*) AS n FROM events WHERE event_id % 10 = 0")
def ingest_quarantine(spark, sf):
    into = Ingest(catalog(spark))
    rows = load(spark, sf, "events").orderBy("event_id").select(F.when(F.col("event_id") % 10 == 0, F.format_string("[%s]", F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct("event_id", "event_type"))).alias("record"))
    into.frame("feed", rows)
    return into.catalog.table("ingest_quarantine").snapshot().groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 1 THEN event_type END AS note FROM events")
def ingest_rebuild(spark, sf):
    into, events = Ingest(catalog(spark)), load(spark, sf, "events").orderBy("event_id")
    into.frame("feed", events.where("event_id % 2 = 0").select(F.to_json(F.struct("event_id")).alias("record")))
    into.frame("feed", events.where("event_id % 2 = 1").select(F.to_json(F.struct(F.col("event_id").alias("eventId"), F.col("event_type").alias("note"))).alias("record")))
    return into.catalog.table("feed").snapshot().select("event_id", "note")


LITERALS = ['"02134"', "9007199254740993", '"12.50"', "0.1234567891", "1e3", "1700000000", "true", '"2026-09-23"', "[1, 2]", "null"]


# Expected rows: by raw value, the kinds it converts to exactly.
_FITS = {
    '"02134"': "string json", "9007199254740993": "int64 float64 decimal string json", '"12.50"': "float64 decimal string json", "0.1234567891": "float64 string json", "1e3": "float64 string json",
    "1700000000": "int64 float64 decimal timestamp_seconds string json", "true": "boolean string json", '"2026-09-23"': "timestamp_text string json", "[1, 2]": "json", "null": "",
}


@query(f"SELECT * FROM (VALUES {', '.join(str((raw, *(k in kinds.split() for k in literals.KINDS))) for raw, kinds in _FITS.items())}) AS t(raw, {', '.join(f'\"{k}\"' for k in literals.KINDS)})")
def ingest_literal_kinds(spark, sf):
    df = spark.createDataFrame([(raw, f'{{"v": {raw}}}') for raw in LITERALS], "raw string, record string").withColumn("v", literals.fields("record")["v"])
    return df.select("raw", *[literals.fits(k, F.col("v")).alias(k) for k in literals.KINDS])


@query("""SELECT field, kind FROM (VALUES ('event_id', 'int64'), ('event_id', 'float64'), ('event_id', 'decimal'), ('event_id', 'string'), ('user_id', 'int64'), ('user_id', 'float64'), ('user_id', 'decimal'), ('user_id', 'string'),
('event_type', 'string'), ('value', 'float64'), ('value', 'decimal'), ('value', 'string'), ('_props', 'string'), ('mixed', 'string'), ('nested', 'json'), ('none', 'string')) AS t(field, kind) WHERE EXISTS (SELECT 1 FROM events)""")
def ingest_candidates(spark, sf):
    """By field, the kinds that all of its values convert to; of values that are all null, string, and with a nested one, json."""
    key = F.col("event_id")
    more = [F.when(key % 2 == 0, F.col("event_type")).otherwise(key.cast("string")).alias("mixed"), F.when(key % 2 == 0, F.array(key)).alias("nested"), F.lit(None).cast("string").alias("none")]
    # so many parts as there are workers for; the file itself has few
    events = load(spark, sf, "events").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    whole = events.select(F.to_json(F.struct("event_id", "user_id", "event_type", F.col("value").cast("decimal(12,2)").alias("value"), F.col("props").alias("_props"), *more), {"ignoreNullFields": "false"}).alias("record"))
    facts = profile(whole.select(literals.fields_once("record").alias("fields")))
    return spark.createDataFrame([(field, kind) for field, seen in facts.items() for kind in literals.candidates(seen)], "field string, kind string")


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE AS price FROM orders")
def ingest_convert_decimal(spark, sf):
    raw = load(spark, sf, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("p"))).alias("record"))
    return raw.select("o_orderkey", literals.convert("decimal", literals.fields("record")["p"]).cast("double").alias("price"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def ingest_epoch_units(spark, sf):
    raw = load(spark, sf, "events").select("event_id", F.to_json(F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))).alias("record"))
    return raw.select("event_id", F.unix_seconds(literals.convert("timestamp_seconds", literals.fields("record")["s"])).alias("seconds"))


@query("""SELECT source, CASE WHEN n = 0 OR (k < 2 AND n > 1) THEN 'no' WHEN c >= 60 AND w >= 8 THEN 'clearly' WHEN c >= 24 AND w >= 3 THEN 'maybe' ELSE 'no' END AS grade
FROM (SELECT source, count(*) FILTER (trim(text) <> '') AS n, count(DISTINCT text) FILTER (trim(text) <> '') AS k, floor(sum(length(text)) FILTER (trim(text) <> '') / count(*) FILTER (trim(text) <> '')) AS c,
floor(sum(len(regexp_extract_all(text, '\\S+'))) FILTER (trim(text) <> '') / count(*) FILTER (trim(text) <> '')) AS w FROM documents GROUP BY source)""".replace("\\\\", "\\"))
def ingest_prose(spark, sf):
    return load(spark, sf, "documents").groupBy("source").agg(prose(F.col("text")).alias("grade"))


# views
def raw_events(spark: SparkSession, sf: str) -> Views:
    own = catalog(spark)
    own.create("raw", load(spark, sf, "events").select("event_id", "user_id", "event_type", "value").orderBy("event_id"), ["event_id"])
    return Views(own)


def rows_of(spark: SparkSession, sf: str, parts: int) -> int:
    """Rows in a batch, so that a drain has so many passes."""
    return max(1, -(-load(spark, sf, "events").count() // parts))


_BIG = "SELECT event_id, upper(event_type) AS kind, value FROM events WHERE value > 20"


@query(_BIG)
def view_incremental(spark, sf):
    views = raw_events(spark, sf)
    views.define(View("big", "raw", "select event_id, upper(event_type) as kind, value from raw where value > 20", target="big", batch_rows=rows_of(spark, sf, 3)))
    views.drain("big")
    return views.catalog.table("big").snapshot()


@query(f"SELECT event_id, kind FROM ({_BIG}) WHERE kind <> 'CLICK'")
def view_cascade(spark, sf):
    views, rows = raw_events(spark, sf), rows_of(spark, sf, 2)
    views.define(View("big", "raw", "select event_id, upper(event_type) as kind, value from raw where value > 20", target="silver", batch_rows=rows))
    views.define(View("rest", "silver", "select event_id, kind from silver where kind <> 'CLICK'", target="gold", batch_rows=rows))
    views.advance_all()
    return views.catalog.table("gold").snapshot()


@query(_BIG)
def view_replay_idempotent(spark, sf):
    views = raw_events(spark, sf)
    views.define(View("big", "raw", "select event_id, upper(event_type) as kind, value from raw where value > 20", target="big", batch_rows=rows_of(spark, sf, 2)))
    views.drain("big")
    views._move("big", 0)
    views.drain("big")
    return views.catalog.table("big").snapshot()


@query("SELECT min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // CAST(ceil((SELECT count(*) FROM events) / 4.0) AS BIGINT) AS b FROM events) GROUP BY b")
def view_batch_local_agg(spark, sf):
    views = raw_events(spark, sf)
    views.define(View("sums", "raw", "select min(event_id) as first_id, max(event_id) as last_id, count(*) as n from raw", target="sums", batch_rows=rows_of(spark, sf, 4)))
    views.drain("sums")
    return views.catalog.table("sums").snapshot()


def _route(rows, ctx):
    ctx.write("hot", [{"event_id": r["event_id"]} for r in rows if r["value"] > 90])
    return [{"event_id": r["event_id"], "state": "warm"} for r in rows if 60 < r["value"] <= 90]


@query("SELECT event_id, CASE WHEN value > 90 THEN 'hot' ELSE 'warm' END AS state FROM events WHERE value > 60")
def view_worker_route(spark, sf):
    views = raw_events(spark, sf)
    views.define(View("route", "raw", worker=_route, target="warm", batch_rows=rows_of(spark, sf, 2)))
    views.drain("route")
    warm, hot = views.catalog.table("warm").snapshot(), views.catalog.table("hot").snapshot()
    return warm.select("event_id", "state").union(hot.select("event_id", F.lit("hot")))


@query("SELECT event_id FROM events WHERE value > 95")
def view_alert_rows(spark, sf):
    views = raw_events(spark, sf)
    sent = f"{views.catalog.files.root}/sent"

    def send(rows: list[dict]) -> bool:
        spark.createDataFrame(pa.table({"event_id": pa.array([r["event_id"] for r in rows], pa.int64())})).write.mode("append").parquet(sent)
        return True

    send([])
    views.define(View("alert", "raw", "select event_id from raw where value > 95", alert=send, batch_rows=rows_of(spark, sf, 2)))
    views.drain("alert")
    return spark.read.schema("event_id long").parquet(sent)


# schedules and phrases
@query("""SELECT cron, CAST(epoch(due) AS BIGINT) AS next FROM (VALUES ('* * * * *', TIMESTAMP '2026-01-01 00:01:00'), ('*/5 * * * *', TIMESTAMP '2026-01-01 00:05:00'), ('30 9 * * *', TIMESTAMP '2026-01-01 09:30:00'),
('0 10 * * 1-5', TIMESTAMP '2026-01-01 10:00:00'), ('0,30 * * * *', TIMESTAMP '2026-01-01 00:30:00'), ('0 0 13 * 5', TIMESTAMP '2026-01-02 00:00:00'), ('0 0 30 2 *', NULL), ('0 0 * * 1-7', TIMESTAMP '2026-01-02 00:00:00')) AS t(cron, due)""")
def schedule_cron_table(spark, sf):
    start = 1_767_225_600
    cases = ("* * * * *", "*/5 * * * *", "30 9 * * *", "0 10 * * 1-5", "0,30 * * * *", "0 0 13 * 5", "0 0 30 2 *", "0 0 * * 1-7")
    return spark.createDataFrame([(c, Cron.parse(c).next_after(start)) for c in cases], "cron string, next long")


@query("""SELECT s AS every, n AS now_ms, n // (s * 1000) * s * 1000 AS at_ms, n // (s * 1000) AS missed
FROM (SELECT unnest([1, 60, 3600])::BIGINT AS s), (SELECT unnest([500, 61000, 7300000])::BIGINT AS n)""")
def schedule_catch_up(spark, sf):
    return spark.createDataFrame([(s, n, *Every(s).catch_up(0, n)) for s in (1, 60, 3600) for n in (500, 61_000, 7_300_000)], "every long, now_ms long, at_ms long, missed long")


@query("""SELECT * FROM (VALUES ('orders in the last 7 days', '["2026-09-11 to 2026-09-18"]'), ('acme orders in seattle', '["acme", "seattle"]'), ('over $45.50 in march 2025', '["45.5", "2025-03-01 to 2025-03-31"]'),
('twenty five parts on the 3rd', '["25", "parts", "2026-09-03"]')) AS t(phrase, found)""")
def phrase_values(spark, sf):
    today = dt.date(2026, 9, 18)
    phrases = ("orders in the last 7 days", "acme orders in seattle", "over $45.50 in march 2025", "twenty five parts on the 3rd")
    return spark.createDataFrame([(p, json.dumps([v.label for v in values(p, today, ["orders"], ["in", "the", "over"])])) for p in phrases], "phrase string, found string")


@query(f"SELECT doc_id, CAST(len({_TOKENS}) AS INT) AS n FROM documents")
def text_words(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.size(words(F.col("text"))).alias("n"))


@query("SELECT kind, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM (SELECT event_id, upper(event_type) AS kind, value FROM events WHERE value > 20) GROUP BY kind")
def flagship(spark, sf):
    views = raw_events(spark, sf)
    views.define(View("big", "raw", "select event_id, upper(event_type) as kind, value from raw where value > 20", target="big", batch_rows=rows_of(spark, sf, 2)))
    views.drain("big")
    return sql.prepare(views.catalog, 'SELECT kind, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM "big" GROUP BY kind')


@query(r"""SELECT o_orderkey, time_bucket(INTERVAL 1 DAY, o_orderdate, TIMESTAMP '1970-01-01') AS day, starts_with(o_orderpriority, '1') AS urgent, CAST(instr(o_orderpriority, '-') AS INT) AS dash, lower(to_hex(o_orderkey)) AS hx,
sha256(o_orderpriority) AS sha, CAST(o_orderkey // 7 AS BIGINT) AS seventh, CAST(gcd(o_orderkey, 36) AS BIGINT) AS g, CAST(lcm(o_orderkey % 50, 6) AS BIGINT) AS l FROM orders""")
def dialect_functions(spark, sf):
    from ..functions import dialect

    own = catalog(spark)
    own.create("orders", load(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), "o_orderpriority"), ["o_orderkey"])
    text = "SELECT o_orderkey, date_bin(INTERVAL '1 00:00:00' DAY TO SECOND, o_orderdate) AS day, starts_with(o_orderpriority, '1') AS urgent, strpos(o_orderpriority, '-') AS dash, to_hex(o_orderkey) AS hx, sha256(o_orderpriority) AS sha FROM orders"
    key = F.col("o_orderkey")
    more = (dialect.integer_divide(key, F.lit(7)).alias("seventh"), dialect.gcd(key, F.lit(36)).alias("g"), dialect.lcm(key % 50, F.lit(6)).alias("l"))
    return sql.prepare(own, text, SqlFunctions()).withColumn("day", F.col("day").cast("timestamp_ntz")).select("*", *more)


@query("SELECT event_type, round(var_samp(value), 6) AS v, round(covar_samp(value, user_id), 6) AS c, 'var(x)' AS said, CAST(2 AS INT) AS two FROM events GROUP BY event_type")
def dialect_names(spark, sf):
    own = catalog(spark)
    own.create("events", load(spark, sf, "events").select("event_id", "event_type", "value", "user_id"), ["event_id"])
    return sql.prepare(own, "SELECT event_type, round(var(value), 6) AS v, round(covar(value, user_id), 6) AS c, 'var(x)' AS said, array_length(make_array(1, 2)) AS two FROM events GROUP BY event_type", SqlFunctions())
