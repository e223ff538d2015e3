import json
import time

import pytest
from pyspark.sql import functions as F

from tidemark.errors import Missing, Refused
from tidemark.plans import engine
from tidemark.sources import feeds
from tidemark.sources.tables import Catalog
from tidemark.streaming.schedule import Alarm, At, Cron, Every, wait_ms
from tidemark.streaming import views as module
from tidemark.streaming.views import Progress, View, Views
from tidemark.streaming.workers import Context, Overtime, turn

START = 1_767_225_600  # 2026-01-01


@pytest.mark.parametrize(
    ("cron", "after", "want"),
    [
        ("* * * * *", START + 30, START + 60), ("*/5 * * * *", START, START + 300), ("*/5 * * * *", START + 300, START + 600), ("30 9 * * *", START, START + 9 * 3600 + 1800), ("30 9 * * *", START + 9 * 3600 + 1800, START + 86400 + 9 * 3600 + 1800),
        ("0 10 * * 1-5", 1_767_348_000, 1_767_607_200), ("0,30 * * * *", START, START + 1800), ("0,30 * * * *", START + 1800, START + 3600), ("50/5 * * * *", START, START + 3000), ("0 0 30 2 *", START, None), ("0 0 13 * 5", START, START + 86400), ("0 0 * * 1-7", START, START + 86400),
    ],
)
def test_cron(cron, after, want):
    assert Cron.parse(cron).next_after(after) == want


@pytest.mark.parametrize(("cron", "said"), [("* * * *", "five fields"), ("60 * * * *", "minute"), ("* 24 * * *", "hour"), ("* * 0 * *", "day of month"), ("* * * 13 *", "month"), ("*/0 * * * *", "step of zero"), ("x * * * *", "minute")])
def test_cron_refusals(cron, said):
    with pytest.raises(Refused, match=said):
        Cron.parse(cron)


def test_alarms():
    assert [wait_ms(n) for n in (1, 2, 7, 9)] == [2000, 4000, 128000, 128000]
    assert Every(10).catch_up(0, 35_000) == (30_000, 3) and At("* * * * *").catch_up(START * 1000, START * 1000 + 150_000) == (START * 1000 + 120_000, 2)
    assert Cron.parse("0 0 * * 0") == Cron.parse("0 0 * * 7")
    a = Alarm.interval(60, 0)
    f = a.begin(200_000)
    assert (f.scheduled_ms, f.missed, f.attempt) == (180_000, 3, 1) and a.begin(200_001) is None
    assert a.complete(f, True, 201_000) and a.at_ms == 240_000
    f = a.begin(240_000)
    assert a.complete(f, False, 240_001) and a.at_ms == 242_000
    f = a.begin(242_000)
    assert f.attempt == 2
    for now in (246_000, 254_000, 270_000):  # a retry that would come after the next occurrence hands over
        a.complete(f, False, now)
        f = a.begin(max(now, a.at_ms)) or f
    assert f.scheduled_ms >= 240_000
    b = Alarm.once(5)
    f = b.begin(5)
    assert not b.complete(f, True, 6)
    b = Alarm.once(5, 1)
    f = b.begin(5)
    b.id = 2
    assert b.complete(f, True, 6)
    b = Alarm.once(0)
    now, alive = 0, True
    for _ in range(7):
        f = b.begin(now)
        alive = b.complete(f, False, now)
        now = b.at_ms
    assert not alive


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path))


def bronze(spark, catalog, n=10, at=0):
    rows = [(i, f"user{i % 3}", float(i)) for i in range(at, at + n)]
    df = spark.createDataFrame(rows, "id long, who string, value double").coalesce(1)
    return catalog.table("raw").append(df) if "raw" in catalog.names() else catalog.create("raw", df, ["id"])


def test_cascade_equals_one_shot_and_replay_adds_nothing(spark, catalog):
    bronze(spark, catalog)
    views = Views(catalog)
    views.define(View("clean", "raw", "select id, upper(who) as who, value from raw where value >= 2", target="silver", batch_rows=4))
    views.define(View("sums", "silver", "select who, count(*) as n, sum(value) as total from silver group by who", target="gold", batch_rows=3))
    used = views.advance_all()
    assert used < 64 and not views.failed
    want = {(i, f"USER{i % 3}", float(i)) for i in range(2, 10)}
    assert {tuple(r) for r in catalog.table("silver").snapshot().collect()} == want
    assert catalog.table("gold").snapshot().agg(F.sum("n")).first()[0] == 8  # batch by batch
    views._move("clean", 0)
    assert views.drain("clean").caught_up and catalog.table("silver").count_rows() == 8
    bronze(spark, catalog, 2, 9)
    assert views.drain("clean").rows == 2 and catalog.table("silver").count_rows() == 9
    assert views.advance("clean").rows == 0 and views.define(View("idle", "nowhere", "select 1", target="x")) and views.advance("idle").caught_up


def test_batches_are_whole(spark, catalog, tmp_path):
    """A view's batch is as large as it says, and a drain or a cascade goes on until nothing is left."""
    (tmp_path / "sf").mkdir()
    spark.range(600_000).selectExpr("id as event_id", "id % 7 as user_id", "'click' as event_type", "1.0D as value").write.parquet(str(tmp_path / "sf/events.parquet"))
    got = engine.view_batch_local_agg(spark, str(tmp_path / "sf")).orderBy("first_id").collect()
    assert [tuple(r) for r in got] == [(i, i + 149_999, 150_000) for i in range(0, 600_000, 150_000)]
    views, left = Views(catalog), {"drained": 1200, "all": 100}

    def advance(name):
        left[name] -= left[name] > 0
        return Progress(int(left[name] > 0), caught_up=left[name] == 0)

    views.advance = advance
    views.drain("drained")
    views.views = {"all": None}
    views.advance_all()
    assert left == {"drained": 0, "all": 0}


def test_many_rows_of_a_pass(spark, catalog, monkeypatch):
    """Beyond a turn's rows a batch is counted out where it is, and a worker and an alert get it in parts, none of it twice."""
    monkeypatch.setattr(module, "MOST_BATCH", 4)
    monkeypatch.setattr(module, "COUNTS", 3)
    bronze(spark, catalog, 10)
    bronze(spark, catalog, 15, 10)
    sent = []

    def route(rows, ctx):
        ctx.write("seen", [{"most": len(rows), "first": rows[0]["id"]}])
        ctx.set_alarm(int(rows[-1]["id"]))
        return [{"id": r["id"], "state": "warm"} for r in rows if r["value"] >= 3]

    views = Views(catalog)
    views.define(View("route", "raw", worker=route, target="warm", alert=lambda rows: sent.append(rows) or True, batch_rows=11))
    views.define(View("sums", "raw", "select min(id) as low, max(id) as high, count(*) as n from raw", target="sums", batch_rows=10))
    assert views.drain("route").rows == 25 and views.drain("sums").rows == 25
    assert [r.id for r in catalog.table("warm").frame().orderBy("_tm_seq").collect()] == list(range(3, 25))
    assert [r["id"] for part in sent for r in part] == list(range(3, 25)) and max(map(len, sent)) <= 4
    assert max(r.most for r in catalog.table("seen").snapshot().collect()) <= 4
    assert sorted(tuple(r) for r in catalog.table("sums").snapshot().collect()) == [(0, 9, 10), (10, 19, 10), (20, 24, 5)]
    assert views.views["route"].alarm.at_ms == 24
    assert not [n for n in catalog.files.names("") if n.startswith("turns-")]
    views.define(View("down", "raw", worker=lambda rows, ctx: 1 / 0, target="none", batch_rows=11))
    with pytest.raises(Exception, match="ZeroDivisionError"):
        views.advance("down")
    assert views.cursor("down") == 0 and "none" not in catalog.names()


def test_worker_side_outputs_and_alert(spark, catalog):
    bronze(spark, catalog)
    sent = []

    def route(rows, ctx):
        ctx.write("hot", [{"id": r["id"]} for r in rows if r["value"] > 7])
        return [{"id": r["id"], "state": "warm"} for r in rows if 3 < r["value"] <= 7]

    views = Views(catalog)
    views.define(View("route", "raw", worker=route, target="warm", alert=lambda rows: sent.extend(rows) or True))
    assert views.drain("route").written == 4 and len(sent) == 4
    assert {r.id for r in catalog.table("hot").snapshot().collect()} == {8, 9}
    views.define(View("down", "raw", "select id from raw", alert=lambda rows: False))
    with pytest.raises(RuntimeError):
        views.advance("down")
    assert views.cursor("down") == 0
    views.advance_all()
    assert list(views.failed) == ["down"]
    for bad in (dict(source="raw", sql="x", target="raw"), dict(source="raw", target="y"), dict(sql="x", target="y"), dict(source="raw", sql="x", target="y", batch_rows=0), dict(source="raw", sql="x", target="y", cron="* * * * *", every_seconds=1)):
        with pytest.raises(Refused):
            View("v", **bad)


def test_clocked_worker_and_requests(spark, catalog):
    class Poll:
        def batch(self, rows, ctx):
            got = ctx.call("https://api.example.org/x", token="{{env:NOPE}}")
            return [{"n": got, "missed": ctx.missed}]

        def fetch(self, request, ctx):
            ctx.write("asked", [{"path": request["path"]}])
            return {"status": 200}

    now = [1000.0]
    views = Views(catalog, transport=lambda url, **k: len(url), clock=lambda: now[0])
    views.define(View("poll", worker=Poll(), target="polled", every_seconds=60, hosts=("example.org",)))
    assert views.advance("poll").written == 1 and views.advance("poll").written == 0
    now[0] += 200
    assert views.advance("poll").written == 1
    assert sorted(r.missed for r in catalog.table("polled").snapshot().collect()) == [0, 2]
    assert views.fetch("poll", {"path": "/a"}) == {"status": 200} and catalog.table("asked").count_rows() == 1
    with pytest.raises(Missing):
        views.fetch("none", {})


def test_turns():
    with pytest.raises(Refused, match="not allowed"):
        turn(lambda rows, ctx: ctx.call("https://evil.org"), [], Context(hosts=("good.org",), transport=print))
    with pytest.raises(Refused, match="own source"):
        turn(lambda rows, ctx: ctx.write("s", []), [], Context(source="s"))
    for bad in (lambda r, c: None, lambda r, c: {"a": 1}, lambda r, c: [1]):
        with pytest.raises(Refused):
            turn(bad, [], Context())
    assert turn(lambda r, c: c.set_alarm(5), [], Context()) == []
    with pytest.raises(Overtime):
        turn(lambda r, c: time.sleep(2), [], Context(), seconds=0.1)


def test_structured_streaming_drives_a_view(spark, catalog, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"id": i}) for i in range(5)))
    views = Views(catalog)
    views.define(View("twice", "fed", "select id, id * 2 as twice from fed", target="doubled"))
    views.stream("twice", str(tmp_path / "in"), "id long", str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r.twice for r in catalog.table("doubled").snapshot().collect()) == [0, 2, 4, 6, 8]


def test_feeds(spark, catalog):
    table = catalog.define({"name": "t", "columns": [{"name": "id", "kind": "int64"}, {"name": "p", "kind": "decimal"}, {"name": "at", "kind": "timestamp"}, {"name": "x", "kind": "float64"}], "primary_key": ["id"]})
    df = feeds.json_rows(spark, table.definition, '{"rows": [{"id": 1, "p": "12.5", "at": 1700000000000000, "x": 1}, {"id": 2}]}')
    assert table.append(df) == 2 and [str(v) for v in table.snapshot().where("id = 1").first()] == ["1", "12.500000000", "2023-11-14 22:13:20", "1.0"]
    for bad in ('{"rows": [{"id": "1"}]}', '{"rows": [{"id": 1, "y": 2}]}', '{"rows": [{"p": 1}]}', "[]"):
        with pytest.raises(Refused):
            feeds.json_rows(spark, table.definition, bad)
    import pyarrow as pa

    data = feeds.arrow_file(table.snapshot())
    assert data[:6] == b"ARROW1" and pa.ipc.open_file(data).read_all().num_rows == 2
    with pytest.raises(Refused):
        feeds.arrow_stream(spark, data)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("a", pa.int64())])) as w:
        w.write_table(pa.table({"a": [1, 2]}))
    assert feeds.arrow_stream(spark, sink.getvalue().to_pybytes()).count() == 2
    assert json.loads(feeds.json_array(table.snapshot().select("id").orderBy("id"))) == [{"id": 1}, {"id": 2}]
    frames = feeds.Frames(lambda: iter(["a", b"x", "b", "c"]), 2, 5.0, sleep=lambda s: time.sleep(30)).start()
    assert frames.batch() == [{"data": "a"}, {"data": "b"}]


def test_socket_source(spark, tmp_path):
    import socket
    import threading

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        conn, _ = server.accept()
        conn.sendall(b"one\ntwo\nthree\n")
        time.sleep(20)
        conn.close()

    threading.Thread(target=serve, daemon=True).start()
    feeds.register(spark)
    got = []
    frame = spark.readStream.format("tm_socket").option("port", server.getsockname()[1]).option("window_ms", 300).load()
    query = frame.writeStream.foreachBatch(lambda df, _: got.extend(r.data for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
    for _ in range(100):
        if len(got) == 3 or query.exception():
            break
        time.sleep(0.3)
    query.stop()
    assert got == ["one", "two", "three"]
