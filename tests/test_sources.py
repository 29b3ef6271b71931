import json
import threading
import urllib.request

import pytest
import spec
from pyspark.sql import functions as F

from tideline.api import Api, serve
from tideline.config import Discovery, duration_ms, targets
from tideline.engine import Engine
from tideline.functions import labels as L
from tideline.rules import AlertRule, RecordingRule, RuleRunner, Scheduler, alert_labels, alert_states, parse_groups
from tideline.sources.exposition import parse_lines, parse_metric
from tideline.sources import store as store_module
from tideline.sources.store import clear, compact, days_of, load, save
from tideline.sources.wide import from_wide
from tideline.streaming.ingest import ingest, scrape_once, text_stream


def test_exposition(spark):
    lines = ['a 1', 'a:b{x="y",z="q\\"\\\\n\\n"} -1.5e3 1234', "# TYPE a counter", "", 'c{} NaN', "d{x=\"\"} +Inf", "bad line here now", "e{x=1} 2", "f one", '{k="v"} 5']
    rows = parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    got = [({p["key"]: p["value"] for p in r["labels"]}, r["value"], r["ts"]) if r["labels"] is not None else r["line"] for r in rows]
    assert got[0] == ({"__name__": "a"}, 1.0, None)
    assert got[1] == ({"__name__": "a:b", "x": "y", "z": 'q"\\n\n'}, -1500.0, 1234)
    assert got[2][0] == {"__name__": "c"} and got[2][1] != got[2][1]
    assert got[3] == ({"__name__": "d"}, float("inf"), None)
    assert got[4:7] == lines[6:9]
    assert got[7] == ({"k": "v"}, 5.0, None)
    assert parse_metric('foo{bar="a\\"b"}') == {"__name__": "foo", "bar": 'a"b'}
    with pytest.raises(ValueError):
        parse_metric("1 2")


def test_wide(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1000, 2.0, 5.0)], 'ts long, `a{x="1"}` double, `b.c` double'.replace("b.c", "b")).withColumnRenamed("b", 'b{y="2.5"}')
    store = from_wide(df)
    rows = store.samples.join(store.series, "sid").select("name", "ts", "value").collect()
    assert sorted((r["name"], r["ts"], r["value"]) for r in rows) == [("a", 0, 1.0), ("a", 1000, 2.0), ("b", 1000, 5.0)]


def test_store_folder_and_api(spark, tmp_path):
    path, wide = str(tmp_path / "store"), str(tmp_path / "wide.parquet")
    save(spec.store(spark, [(60_000, 'a{i="1"} 0+60x10'), (60_000, 'a{i="2"} 0+120x10')]), path)
    spark.createDataFrame([(0, 3.0), (86_400_000, 4.0)], 'ts long, `w{i="9"}` double').write.parquet(wide)
    api = Api(spark, path)
    assert api.handle("POST", "/api/v1/scrape_data", {"path": [wide]})[0] == 200
    status, body = api.handle("GET", "/api/v1/query_range", {"query": ["rate(a[2m])"], "start": ["240"], "end": ["1970-01-01T00:05:00Z"], "step": ["1m"]})
    assert status == 200 and body["data"]["resultType"] == "matrix"
    assert sorted((m["metric"]["i"], m["values"]) for m in body["data"]["result"]) == [("1", [[240.0, "1"], [300.0, "1"]]), ("2", [[240.0, "2"], [300.0, "2"]])]
    assert api.handle("GET", "/api/v1/query", {"query": ["sum(a)"], "time": ["60"]})[1]["data"]["result"][0]["value"] == [60.0, "180"]
    assert api.handle("GET", "/api/v1/label/i/values", {})[1]["data"] == ["1", "2", "9"]
    assert api.handle("GET", "/api/v1/series", {"match[]": ['{i=~"1|9"}']})[1]["data"].__len__() == 2
    assert api.handle("GET", "/api/v1/query_range", {"query": ["a"]})[0] == 400
    assert api.handle("GET", "/api/v1/query", {"query": ["a +"]})[0] == 500
    assert api.handle("GET", "/nowhere", {})[0] == 404
    server = serve(api, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/api/v1/query?query=1%2B1&time=0") as r:
        assert json.loads(r.read())["data"] == {"resultType": "scalar", "result": [0.0, "2"]}
    server.shutdown()
    clear(spark, path, 0, 1000)
    assert sorted(r["ts"] for r in load(spark, path).samples.join(load(spark, path).series.filter("name = 'w'"), "sid").collect()) == [86_400_000]
    api.handle("DELETE", "/api/v1/scrape_data", {})
    assert load(spark, path).samples.count() == 0


def test_last_written_wins(spark, tmp_path):
    path = str(tmp_path / "s")
    save(spec.store(spark, [(1000, "a 1 2 3")]), path)
    save(spec.store(spark, [(1000, "a _ 9")]), path)
    rows = lambda **how: sorted((r["ts"], r["value"]) for r in load(spark, path, **how).samples.collect())
    assert rows() == [(0, 1.0), (1000, 9.0), (2000, 3.0)] and len(rows(last_wins=False)) == 4
    assert Engine(load(spark, path)).query_instant("sum_over_time(a[1m])", 2000).first()["value"] == 13.0
    compact(spark, path, [0])
    assert rows(last_wins=False) == rows() == [(0, 1.0), (1000, 9.0), (2000, 3.0)]


def test_days_that_were_written_once_are_read_as_they_are(spark, tmp_path):
    path = str(tmp_path / "s")
    day = 86_400_000
    save(spec.store(spark, [(day, "a 1 2 3"), (1000, "b 5x10")]), path)
    plan = lambda: load(spark, path).samples._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan()
    save(spec.store(spark, [(day, "a _ 7")]), path)
    assert {d: len(s) for d, s in days_of(spark, path).items()} == {0: 1, 1: 2, 2: 1} and "Aggregate" in plan()
    rows = lambda: sorted((r["ts"], r["value"]) for r in load(spark, path).samples.filter(f"ts % {day} = 0 and ts > 0").collect())
    assert rows() == [(day, 7.0), (2 * day, 3.0)]
    compact(spark, path)
    assert {d: len(s) for d, s in days_of(spark, path).items()} == {0: 1, 1: 1, 2: 1} and "Aggregate" not in plan() and rows() == [(day, 7.0), (2 * day, 3.0)]


def test_a_day_rewritten_counts_from_its_name_on(spark, tmp_path, monkeypatch):
    """A run that dies before the renaming leaves the old day; one that dies after it leaves the new day."""
    path = str(tmp_path / "s")
    save(spec.store(spark, [(1000, "a 1 2 3 4")]), path)
    rows = lambda: sorted(r["ts"] for r in load(spark, path).samples.collect())

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store_module, "_delete", dies)  # after the new folder has its name
        with pytest.raises(KeyboardInterrupt):
            clear(spark, path, 1000, 2000)
    assert rows() == [0, 3000] and len(list((tmp_path / "s/samples/bucket=0").glob("seq=*"))) == 2
    with monkeypatch.context() as m:
        m.setattr(store_module, "_last_written", dies)  # before
        with pytest.raises(KeyboardInterrupt):
            clear(spark, path, 0, 0)
    assert rows() == [0, 3000]
    clear(spark, path, 0, 0)
    assert rows() == [3000] and len(list((tmp_path / "s/samples/bucket=0").glob("seq=*"))) == 1


def test_clear_drops_whole_days(spark, tmp_path):
    path, day = str(tmp_path / "s"), 86_400_000
    save(spec.store(spark, [(day // 4, "a 0+1x15")]), path)
    clear(spark, path, day // 2, 3 * day - 1)
    assert sorted(days_of(spark, path)) == [0, 3]
    assert sorted(r["value"] for r in load(spark, path).samples.collect()) == [0, 1, 12, 13, 14, 15]


def test_a_day_gets_files_by_its_size(spark, tmp_path):
    from tideline.sources.store import store_of

    rows = spark.range(0, 200_000, 1, 8).select(L.of_columns({L.NAME: F.lit("m"), "k": (F.col("id") % 50).cast("string")}).alias("labels"), (F.col("id") * 400).alias("ts"), F.rand().alias("value"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        save(store_of(rows), str(tmp_path / "big"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    save(spec.store(spark, [(1000, "a 1 2 3")]), str(tmp_path / "small"))
    files = lambda name: len(list((tmp_path / name / "samples").glob("bucket=0/*/*.parquet")))
    assert files("big") > 3 and files("small") == 1


def test_alerts(spark):
    store = spec.store(spark, [(1000, 'foo{s="a"} 1 2 3 4 0 5'), (1000, 'foo{s="b"} 0 0 3 3 3 3')])
    engine, rule = Engine(store), AlertRule("hot", "foo > 2", wait=1000, labels={"team": "x"})
    state, seen = None, []
    for at in range(0, 6000, 1000):
        state = alert_states(engine, rule, at, state)
        state = spark.createDataFrame(state.collect(), state.schema)
        seen.append({r["labels"]["s"]: (r["fired_since"], r["status"]) for r in state.collect()})
    assert seen == [{}, {}, {"a": (2000, "PENDING"), "b": (2000, "PENDING")}, {"a": (2000, "FIRING"), "b": (2000, "FIRING")}, {"b": (2000, "FIRING")}, {"a": (5000, "PENDING"), "b": (2000, "FIRING")}]
    assert {tuple(sorted(r["labels"].items())) for r in alert_labels(rule, state).collect()} == {(("alertname", "hot"), ("s", s), ("team", "x")) for s in "ab"}


def test_rule_runner(spark, tmp_path):
    path = str(tmp_path / "s")
    save(spec.store(spark, [(1000, 'foo{s="a"} 1 2 3 4'), (1000, 'foo{s="b"} 5 6 7 8')]), path)
    groups = parse_groups({"groups": [{"name": "g", "interval": "1s", "rules": [{"record": "foo:sum", "expr": "sum(foo)", "labels": {"by": "all"}}, {"alert": "x", "expr": "foo > 3", "for": "1s"}]}]})
    assert groups[0].rules == (RecordingRule("foo:sum", "sum(foo)", {"by": "all"}), AlertRule("x", "foo > 3", 1000))
    runner = RuleRunner(spark, path, groups)
    assert [runner.scheduler.run_due(t) for t in (2000, 2500, 3000)] == [["g"], [], ["g"]] and not runner.scheduler.errors
    assert {r[3] for r in runner.states["g", "x"]} == {"FIRING", "PENDING"}
    rows = Engine(load(spark, path)).query_range("foo:sum", 2000, 3000, 1000).collect()
    assert sorted((r["t"], r["value"], r["labels"]["by"]) for r in rows) == [(2000, 10.0, "all"), (3000, 12.0, "all")]


def test_scheduler():
    s, ran = Scheduler(), []
    s.add("a", ran.append, 10)
    s.add("b", lambda now: 1 / 0, 100)
    assert s.run_due(0) == ["a", "b"] and s.run_due(5) == [] and s.run_due(10) == ["a"]
    s.terminate("a")
    assert s.run_due(30) == [] and ran == [0, 10] and len(s.errors) == 1


def test_config():
    text = "global: {scrape_interval: 30s}\nscrape_configs:\n- job_name: j\n  scheme: https\n  metrics_path: /m\n  params: {x: [1, 2]}\n  honor_labels: true\n  static_configs:\n  - targets: ['h:9', 'k']\n    labels: {a: b}\n"
    found = targets(text)
    assert [(t.url, t.instance, t.interval, t.honor_labels, t.labels) for t in found] == [("https://h:9/m?x=1&x=2", "h:9", 30_000, True, (("a", "b"),)), ("https://k:80/m?x=1&x=2", "k:80", 30_000, True, (("a", "b"),))]
    d = Discovery()
    d.apply(text)
    assert len(d.due(100_000, {found[0].url: 90_000})) == 1
    assert [duration_ms(x) for x in ("5ms", "1.5s", 20, "2m", "1h")] == [5, 1500, 20, 120_000, 3_600_000]


def test_scrape(spark):
    rows = scrape_once(spark, [("h:1", "j", 'a{job="own"} 1\nb 2\n'), ("h:2", "j", None), ("h:3", "j", "# none\n")], 500).collect()
    got = {tuple(sorted((p["key"], p["value"]) for p in r["labels"])): (r["ts"], r["value"]) for r in rows}
    assert got[(("__name__", "a"), ("instance", "h:1"), ("job", "j"))] == (500, 1.0)
    assert {k[1][1]: v[1] for k, v in got.items() if k[0][1] == "up"} == {"h:1": 1.0, "h:2": 0.0, "h:3": 1.0}


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "h1.prom").write_text('a{x="1"} 1\nb 2\n# c\n')
    path, mark = str(tmp_path / "store"), str(tmp_path / "mark")
    ingest(text_stream(spark, str(tmp_path / "in"), "job1"), path, mark).awaitTermination()
    (tmp_path / "in" / "h2.prom").write_text('a{x="1"} 3\n')
    ingest(text_stream(spark, str(tmp_path / "in"), "job1"), path, mark).awaitTermination()
    store = load(spark, path)
    rows = store.samples.join(store.series, "sid").select(L.to_map(F.col("labels")).alias("m"), "value").collect()
    assert sorted((r["m"]["__name__"], r["m"]["instance"], r["value"]) for r in rows) == [("a", "h1", 1.0), ("a", "h2", 3.0), ("b", "h1", 2.0)]


def test_alert_stream(spark, tmp_path):
    from tideline.streaming.alerts import alert_stream

    folder, out = tmp_path / "evaluated", []
    schema = "rule string, series string, ts long, value double, wait long"
    spark.createDataFrame([("r", "s", 0, 1.0, 1000), ("r", "s", 1000, 2.0, 1000), ("r", "q", 0, 0.0, 0)], schema).write.parquet(str(folder))
    for more in ([], [("r", "s", 2000, 0.0, 1000), ("r", "s", 3000, 1.0, 1000)]):
        if more:
            spark.createDataFrame(more, schema).write.mode("append").parquet(str(folder))
        q = alert_stream(spark.readStream.schema(schema).parquet(str(folder))).writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(x[2:] for x in out) == [(0, 0, "PENDING"), (1000, 0, "FIRING"), (2000, 0, "INACTIVE"), (3000, 3000, "PENDING")]


def test_alert_stream_ends_series_that_send_nothing(spark, tmp_path):
    """A series that no longer alerts has no rows: it ends, and the next alert begins anew."""
    from tideline.streaming.alerts import alert_stream

    folder, out = tmp_path / "evaluated", []
    schema = "rule string, series string, ts long, value double, wait long"
    minute = 60_000
    batches = [[("r", "s", k * minute, 9.0, minute) for k in range(3)], [("r", None, 20 * minute, None, minute)], [("r", None, 21 * minute, None, minute)], [("r", "s", 30 * minute, 9.0, minute)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        q = alert_stream(spark.readStream.schema(schema).parquet(str(folder))).writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((x[2] // minute, x[3] // minute, x[4]) for x in out) == [(0, 0, "PENDING"), (1, 0, "FIRING"), (2, 0, "FIRING"), (7, 0, "INACTIVE"), (30, 30, "PENDING")]


def test_scrape_loop(spark, tmp_path):
    """Targets on a local server: one answers, one fails, one is too slow; each has its up, and is asked again when due."""
    import http.server
    import time as clock

    from tideline.streaming.scrape import ScrapeLoop

    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            if self.path == "/slow":
                clock.sleep(6)
            body = f'hits{{job="own"}} {len(asked)}\nplain 7\n'.encode()
            self.send_response(500 if self.path == "/broken" else 200)
            self.end_headers()
            try:
                self.wfile.write(body)
            except OSError:
                pass

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host = f"127.0.0.1:{server.server_port}"
    job = lambda name, path, **more: {"job_name": name, "metrics_path": path, "static_configs": [{"targets": [host], "labels": {"zone": "z"}}], **more}
    found = Discovery()
    found.apply({"global": {"scrape_interval": "10s"}, "scrape_configs": [job("good", "/metrics"), job("kept", "/kept", honor_labels=True, scrape_interval="60s"), job("bad", "/broken"), job("late", "/slow")]})
    path = str(tmp_path / "s")
    loop = ScrapeLoop(spark, path, found, timeout=2)
    assert [loop.run_due(t) for t in (1000, 2000, 12_000)] == [4, 0, 3]
    server.shutdown()
    store = load(spark, path)
    rows = store.samples.join(store.series, "sid").select("name", L.to_map(F.col("labels")).alias("m"), "ts", "value").collect()
    up = {(r["m"]["job"], r["ts"]): r["value"] for r in rows if r["name"] == "up"}
    assert up == {("good", 1000): 1.0, ("kept", 1000): 1.0, ("bad", 1000): 0.0, ("late", 1000): 0.0, ("good", 12_000): 1.0, ("bad", 12_000): 0.0, ("late", 12_000): 0.0}
    assert {(r["m"]["job"], r["m"]["instance"], r["m"]["zone"]) for r in rows if r["name"] == "hits"} == {("good", host, "z"), ("own", host, "z")}
    assert sorted((r["m"]["job"], r["ts"], r["value"]) for r in rows if r["name"] == "plain") == [("good", 1000, 7.0), ("good", 12_000, 7.0), ("kept", 1000, 7.0)]


def test_user_function(spark):
    from tideline.plans.compiler import register_function

    register_function("double_it", lambda v: v * 2)
    rows = Engine(spec.store(spark, [(1000, "a 4")])).query_instant("double_it(a)", 0).collect()
    assert [r["value"] for r in rows] == [8.0]
