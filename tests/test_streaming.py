import datetime
import json
from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from repograph.operators import metrics
from repograph.sources import store
from repograph.streaming import live

SCHEMA = "seq long, ts timestamp, event string, pid long, agent string, node string, outcome string, edge string, state string, root string, path string"
NAMES = [p.strip().split(" ")[0] for p in SCHEMA.split(",")]


def stream(spark, folder, batches):
    """A stream of one file per batch."""
    seq = 0
    for k, rows in enumerate(batches):
        data = []
        for ms, r in rows:
            data.append(tuple({**r, "seq": seq, "ts": datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)}.get(n) for n in NAMES))
            seq += 1
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def finish(df, folder, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def heat(state, edge="e"):
    return {"event": "hotedge", "edge": edge, "state": state}


def test_heat_and_status(spark, tmp_path):
    batches = [[(0, heat("enter")), (1, heat("enter")), (2, {"event": "test", "node": "n", "outcome": "fail"})], [(3, heat("exit")), (4, heat("exit")), (5, heat("enter", "zz")), (6, {"event": "test", "node": "n", "outcome": "pass"})]]
    s = stream(spark, tmp_path, batches)
    edges = spark.createDataFrame([("e", False)], "id string, hot boolean")
    nodes = spark.createDataFrame([("n",)], "id string")
    assert sorted((r.seq, r.hot) for r in finish(live.live_heat(s, edges), tmp_path, "heat")) == [(0, True), (3, False)]
    assert sorted((r.seq, r.status) for r in finish(live.live_status(s, nodes), tmp_path, "status")) == [(2, "failing"), (6, "passing")]


def test_roster(spark, tmp_path):
    act = lambda pid: {"event": "activity", "pid": pid, "agent": "a"}
    s = stream(spark, tmp_path, [[(0, act(1))], [(4000, act(2))], [(70000, act(2))], [(200000, act(3))], [(200001, act(3))]])
    got = finish(live.live_roster(s, delay="0 seconds"), tmp_path, "roster")
    base = 1704067200000
    one = sorted((r.at_ms - base, r.status) for r in got if r.pid == 1)
    two = sorted((r.at_ms - base, r.status) for r in got if r.pid == 2)
    assert one == [(0, "active"), (5001, "inactive"), (60001, "removed")]
    assert two[:4] == [(4000, "active"), (9001, "inactive"), (64001, "removed"), (70000, "active")]


def test_throttle_and_debounce(spark, tmp_path):
    s = stream(spark, tmp_path, [[(i, heat("enter")) for i in range(5)], [(150, heat("enter"))]])
    assert sorted(r.seq for r in finish(live.throttle_stream(s), tmp_path, "throttle")) == [0, 1, 5]
    change = lambda p: {"root": "r", "path": p}
    d = stream(spark, tmp_path / "d", [[(0, change("a")), (100, change("b")), (120, change("a"))], [(400, change("c"))], [(5000, change("x"))], [(9000, change("y"))]])
    got = {(r.burst_start - 1704067200000, r.path) for r in finish(live.debounce_stream(d, delay="0 seconds"), tmp_path, "bounce")}
    assert {(0, "a"), (0, "b"), (400, "c")} <= got


def test_store(spark, tmp_path):
    node = "struct<type: string, label: string, parent_id: string, status: string, docs: string, signature: struct<params: array<struct<name: string, type: string>>, returns: string>, meta: struct<language: string, filePath: string, range: struct<startLine: int, startCol: int, endLine: int, endCol: int>>>"
    base = "struct<pid: bigint, agent: string, type: string, color: string, status: string, version: string>"
    columns = {"pid": "bigint", "agent": "string", "node": "string", "edge": "string", "status": "string", "outcome": "string", "duration_ms": "bigint", "message": "string", "action": "string", "hot": "boolean", "roster": f"array<{base}>"}
    rows = spark.createDataFrame([(1, "node.upsert", "n"), (2, "edge.upsert", "e"), (3, "hot_edge", None), (4, "status.update", None), (5, "test.result", None), (6, "snapshot", None)], "seq long, type string, id string").withColumn("ts", F.timestamp_seconds("seq")).withColumn("session", F.lit("s"))
    for c, t in columns.items():
        rows = rows.withColumn(c, F.lit(None).cast(t))
    rows = rows.withColumn("edge", F.when(F.col("type") == "hot_edge", "e")).withColumn("hot", F.when(F.col("type") == "hot_edge", True)).withColumn("node", F.when(F.col("type").isin("status.update", "test.result"), "n"))
    rows = rows.withColumn("status", F.when(F.col("type") == "status.update", "running")).withColumn("outcome", F.when(F.col("type") == "test.result", "fail")).withColumn("pid", F.when(F.col("type") == "test.result", 9).cast("long"))
    made = F.from_json(F.lit('{"type":"function","label":"n","status":"unknown","signature":{"params":[],"returns":"u8"}}'), node)
    rows = rows.withColumn("row_node", F.when(F.col("type") == "node.upsert", made)).withColumn("row_edge", F.when(F.col("type") == "edge.upsert", F.struct(F.lit("n").alias("source"), F.lit("m").alias("target"), F.lit("calls").alias("kind"), F.lit(False).alias("hot"))))
    path = str(tmp_path / "store")
    for _ in range(2):  # a repeated batch changes nothing
        store.persist_events(rows, path, 0)
    nodes, edges = store.load_graph(spark, path, "s")
    assert [(r.id, r.status, r.signature.returns) for r in nodes.collect()] == [("n", "running", "u8")] and [(r.id, r.hot) for r in edges.collect()] == [("e", True)]
    assert store.load_graph(spark, path, "other")[0].count() == 0
    assert [(r.process_id, r.color) for r in store.load_table(spark, path, "agents").collect()] == [(9, "#888888")]
    assert store.load_table(spark, path, "test_results").count() == 1
    sessions = store.record_session(store.load_table(spark, path, "sessions"), "s", "/x")
    assert sessions.count() == 1 and sessions.first().repo_path == ""


def _envelopes(spark, rows):
    """Envelopes (seq, type, session, id or target, value) of nodes and edges."""
    node = "struct<type: string, label: string, parent_id: string, status: string, docs: string, signature: struct<params: array<struct<name: string, type: string>>, returns: string>, meta: struct<language: string, filePath: string, range: struct<startLine: int, startCol: int, endLine: int, endCol: int>>>"
    base = "struct<pid: bigint, agent: string, type: string, color: string, status: string, version: string>"
    df = spark.createDataFrame(rows, "seq long, type string, session string, key string, value string").withColumn("ts", F.timestamp_seconds("seq"))
    on = lambda *kinds: F.col("type").isin(*kinds)
    columns = {
        "pid": F.lit(None).cast("long"), "agent": F.lit(None).cast("string"), "node": F.when(on("status.update", "test.result"), F.col("key")), "edge": F.when(on("hot_edge"), F.col("key")), "status": F.when(on("status.update"), F.col("value")),
        "outcome": F.when(on("test.result"), F.col("value")), "duration_ms": F.lit(None).cast("long"), "message": F.lit(None).cast("string"), "action": F.lit(None).cast("string"), "hot": F.when(on("hot_edge"), F.col("value") == "hot"),
        "id": F.when(on("node.upsert", "node.remove", "edge.upsert", "edge.remove"), F.col("key")), "roster": F.lit(None).cast(f"array<{base}>"),
        "row_node": F.when(on("node.upsert"), F.from_json(F.concat(F.lit('{"type":"function","status":"unknown","label":"'), "value", F.lit('"}')), node)),
        "row_edge": F.when(on("edge.upsert"), F.struct(F.lit("a").alias("source"), F.lit("b").alias("target"), F.lit("calls").alias("kind"), F.lit(False).alias("hot"))),
    }
    return df.select("seq", "ts", "type", "session", *[c.alias(n) for n, c in columns.items()])


def test_a_bucket_of_many_keys_is_dealt_among_tasks(spark, tmp_path, monkeypatch):
    """A first batch has few buckets however many keys it has; one key has most of the envelopes."""
    monkeypatch.setattr(store, "TASK_STATES", 20)
    path = str(tmp_path / "store")
    batches = [
        [(i, "node.upsert", f"s{i % 2}", f"n{i}", f"label {i}") for i in range(120)] + [(200 + i, "edge.upsert", "s0", f"e{i}", None) for i in range(120)] + [(400 + i, "hot_edge", "s0", "e1", "hot" if i % 3 else "cold") for i in range(101)],
        [(600 + i, "node.remove" if i % 3 else "node.upsert", "s1", f"n{i}", "again") for i in range(0, 120, 2)] + [(700, "status.update", "s1", "n3", "failing"), (699, "status.update", "s1", "n3", "passing")],
    ]
    for k, rows in enumerate(batches):
        store.persist_events(_envelopes(spark, rows), path, k, buckets=2, most=1000)
        files = [sum(1 for f in Path(r["path"]).iterdir() if f.suffix == ".parquet") for r in store._manifest(spark, path) if r["table"] == "nodes" and r["path"]]
        assert len(files) == 2 and min(files) >= 3
    whole = _envelopes(spark, [r for rows in batches for r in rows])
    for name, fold in (("nodes", store.fold_nodes), ("edges", store.fold_edges), ("sessions", store.fold_sessions)):
        got = store.load_table(spark, path, name)
        assert sorted(map(str, got.collect())) == sorted(map(str, fold(whole).select(*got.columns).collect())), name


def test_batches_rewrite_the_buckets_that_they_touch_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    batches = [
        [(i, "node.upsert", f"s{i % 2}", f"n{i}", f"label {i}") for i in range(60)] + [(100 + i, "edge.upsert", f"s{i % 2}", f"e{i}", None) for i in range(10)],
        [(200, "status.update", "s0", "n4", "failing"), (201, "hot_edge", "s0", "e2", "hot"), (202, "test.result", "s0", "n4", "fail")],
        [(300, "node.remove", "s0", "n4", None), (301, "node.upsert", "s1", "n6", "other"), (302, "edge.remove", "s1", "e3", None)],
        [(400, "status.update", "s1", "n6", "passing"), (150, "status.update", "s1", "n8", "late, and behind nothing")],
    ]
    folders = lambda name: {r["path"] for r in store._manifest(spark, path) if r["table"] == name and r["path"]}
    seen = []
    for k, rows in enumerate(batches):
        for _ in range(2 if k == 1 else 1):  # a repeated batch changes nothing
            store.persist_events(_envelopes(spark, rows), path, k, buckets=8)
        seen.append(folders("nodes"))
    assert len(seen[0]) == 8 and len(seen[1] - seen[0]) == 1 and len(seen[2] - seen[1]) <= 2
    whole = _envelopes(spark, [r for rows in batches for r in rows])
    for name, fold in (("nodes", store.fold_nodes), ("edges", store.fold_edges), ("sessions", store.fold_sessions), ("test_results", store.fold_test_results)):
        got = store.load_table(spark, path, name)
        assert sorted(map(str, got.collect())) == sorted(map(str, fold(whole).select(*got.columns).collect())), name
    nodes, edges = store.load_graph(spark, path, "s1")
    assert {r.id: r.status for r in nodes.collect()}["n6"] == "passing" and "n4" not in {r.id for r in store.load_graph(spark, path, "s0")[0].collect()}
    assert {r.id for r in edges.collect()} == {"e1", "e5", "e7", "e9"}
    # Only the last two manifests and what they name are left.
    assert len(list((tmp_path / "store" / "_manifests").iterdir())) == 2
    named = set().union(*seen[-2:])
    assert {str(f) for f in (tmp_path / "store" / "nodes").glob("v-*/bucket=*")} <= {n.removeprefix("file:") for n in named}


def test_buckets_double_and_unfinished_batches_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "store")
    for k in range(3):
        store.persist_events(_envelopes(spark, [(1000 * k + i, "node.upsert", "s", f"n{k}-{i}", "x") for i in range(40)]), path, k, buckets=2, most=10)
    assert {r["buckets"] for r in store._manifest(spark, path) if r["table"] == "nodes"} == {8}
    assert store.load_table(spark, path, "nodes").count() == 120
    store.fold_test_results(_envelopes(spark, [(9000, "test.result", "s", "n0-1", "pass")])).write.parquet(f"{path}/test_results/batch=7")  # a batch that died before its manifest
    assert store.load_table(spark, path, "test_results").count() == 0


def test_quiet_windows_come_as_zero(spark, tmp_path):
    event = {"event": "x"}
    at = [0, 100, 1900, 9000, 9001, 15999, 16000, 16001, 41000]
    batches = [[(t, event) for t in at[:3]], [(t, event) for t in at[3:5]], [(t, event) for t in at[5:8]], [(at[8], event)], [(90000, event)], [(90001, event)]]
    s = stream(spark, tmp_path, batches).withColumn("type", F.lit("x"))
    got = sorted((r.window_ms - 1704067200000, r.n, r.events_per_sec_milli) for r in finish(live.metrics_stream(s, 2000, "0 seconds"), tmp_path, "windows"))
    told = spark.createDataFrame([(t, "x") for t in [*at, 90000, 90001]], "ts_ms long, type string")
    want = sorted((r.window_ms, r.n, r.events_per_sec_milli) for r in metrics.metrics_windows(told, 2000).collect())
    assert got == want[:-1] and len(got) == 45  # the last window is still open


def test_sinks_are_independent(spark, tmp_path):
    had, broken = {"good": [], "bad": []}, [True]

    def good(df, k):
        had["good"].append((k, sorted(r.seq for r in df.collect())))

    def bad(df, k):
        if k == 1 and broken[0]:
            raise OSError("full")
        had["bad"].append((k, sorted(r.seq for r in df.collect())))

    s = stream(spark, tmp_path, [[(i, heat("enter")) for i in range(2)] for _ in range(3)])
    cp = str(tmp_path / "cp")
    live.fan_out(s, {"good": good, "bad": bad}, cp).awaitTermination()
    assert had["good"] == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5])] and had["bad"] == [(0, [0, 1])]
    broken[0] = False
    spark.createDataFrame([(6, None)], "seq long, event string").select("seq", *[F.lit(None).cast(p.split(" ")[1]).alias(p.split(" ")[0]) for p in SCHEMA.split(", ")[1:]]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live.fan_out(s, {"good": good, "bad": bad}, cp).awaitTermination()
    assert had["good"][3:] == [(3, [6])] and had["bad"] == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5]), (3, [6])]
    assert live.deliver(spark, {"good": good, "bad": bad}, f"{cp}-sinks") == {} and len(had["good"]) == 4
    assert list((tmp_path / "cp-sinks" / "batches").iterdir()) == []


def test_hand_over_loses_nothing(spark, tmp_path):
    path, cp, had = str(tmp_path / "store"), str(tmp_path / "cp"), []
    rows = lambda k: [(100 * k + i, "node.upsert", "s" if i % 3 else "other", f"n{i}", f"v{k}") for i in range(6)] + [(100 * k + 50, "test.result", "s", "n1", "pass")]
    sink = lambda df, k: had.extend((r.step, r.batch, r.seq, r.type, r.body) for r in df.collect())
    for k in range(2):
        store.persist_events(_envelopes(spark, rows(k)), path, k)
    live.hand_over(spark, path, "s", sink, cp).awaitTermination()
    store.persist_events(_envelopes(spark, rows(2)), path, 2)  # between the snapshot and the first events
    live.hand_over(spark, path, "s", sink, cp).awaitTermination()
    for k in (3, 4):
        store.persist_events(_envelopes(spark, rows(k)), path, k)
    live.hand_over(spark, path, "s", sink, cp).awaitTermination()
    first, rest = [h for h in had if h[0] == 0], [h for h in had if h[0] == 2]
    assert had == [*first, *rest] and {json.loads(h[4])["id"] for h in first} == {"n1", "n2", "n4", "n5"} and all('"label":"v1"' in h[4] for h in first)
    assert [h[2] for h in rest] == [q[0] for k in (2, 3, 4) for q in rows(k) if q[2] == "s"]


def test_bootstrap_in_steps(spark):
    nodes, agents = spark.createDataFrame([("n",)], "id string"), spark.createDataFrame([], "pid long")
    later = spark.createDataFrame([(4, "hot_edge"), (6, "hot_edge"), (5, "test.result")], "seq long, type string")
    got = [(r.step, r.seq, r.type) for r in live.bootstrap(nodes, agents, later, 4).orderBy("step", "seq").collect()]
    assert got == [(0, 4, "snapshot"), (2, 5, "test.result"), (2, 6, "hot_edge")]


class Store:
    """A state store of one key that counts what is asked of it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_calls_of_the_store_follow_keys_and_not_rows():
    """A key's rows of a batch take at most four calls, and one timer."""
    ts = datetime.datetime(2024, 1, 1)
    rows = [Row(seq=i, ts=ts + datetime.timedelta(milliseconds=i), ms=i, agent="a", status="passing") for i in range(1000)]
    for processor, key in ((live.Throttle(100, 2, 1), ("e", "enter")), (live.Roster(5000, 60000), (1,)), (live.LastValue("node", "status", True, "bigint"), ("n",))):
        at = Store()
        processor.init(at)
        told = list(processor.handleInputRows(key, iter(rows[500:]), None)) + list(processor.handleInputRows(key, iter(rows[:500]), None))
        assert at.calls <= 8 and len(at.timers) <= 1
        assert len(told) == {"Throttle": 20, "Roster": 1, "LastValue": 500}[type(processor).__name__]
    throttle, at = live.Throttle(100, 2, 1), Store()
    throttle.init(at)
    list(throttle.handleInputRows(("e", "exit"), iter(rows), None))
    late = SimpleNamespace(getCurrentWatermarkInMs=lambda: 450)
    at.timers.remove(100)  # as Spark does with a timer that fires
    assert not list(throttle.handleExpiredTimer(("e", "exit"), late, None)) and at.timers == {500} and sorted(at.value[0]) == [4, 5, 6, 7, 8, 9]
