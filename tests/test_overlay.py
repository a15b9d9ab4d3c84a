import random

import pytest
from pyspark.sql import functions as F

from repograph.operators import facts, metrics, overlay

EVENT = "seq long, ts_ms long, event string, pid long, agent string, node string, action string, outcome string, edge string, state string, session string"


def events(spark, rows):
    full = [{"session": "s", **r, "seq": r.get("seq", i)} for i, r in enumerate(rows)]
    names = [p.strip().split(" ")[0] for p in EVENT.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], EVENT).withColumn("ts", F.timestamp_millis(F.coalesce("ts_ms", F.lit(0))))


def act(at, pid=1, agent="a", node="n"):
    return {"event": "activity", "ts_ms": at, "pid": pid, "agent": agent, "node": node, "action": "modified"}


def test_status_and_heat(spark):
    nodes = spark.createDataFrame([("n", "f")], "id string, parent_id string")
    edges = spark.createDataFrame([("e", False)], "id string, hot boolean")
    ev = events(spark, [{"event": "test", "node": "n", "outcome": "fail"}, {"event": "test", "node": "n", "outcome": "pass"}, {"event": "test", "node": "zz", "outcome": "pass"}]
                + [{"event": "hotedge", "edge": "e", "state": s} for s in ("exit", "enter", "enter", "odd", "exit", "exit")] + [{"event": "hotedge", "edge": "zz", "state": "enter"}])
    assert [tuple(r) for r in overlay.latest_status(ev, nodes).collect()] == [("n", "passing")]
    assert [(r.seq, r.hot) for r in overlay.coalesce_hot_transitions(ev, edges).orderBy("seq").collect()] == [(4, True), (7, False)]
    assert [tuple(r) for r in overlay.edge_heat(ev, edges).collect()] == [("e", False)]


def test_heat_of_typed_edges_makes_no_others(spark):
    """Only edges of the kinds that the events name are made; an id that ends like a kind is still found among all edges."""
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    schema = "id string, source string, target string, kind string, hot boolean"
    calls = spark.createDataFrame([("e:a->b:calls", "a", "b", "calls", False), ("e:b->c:calls", "b", "c", "calls", True)], schema)
    plain = spark.createDataFrame([("e:f->fn:f:calls", "f", "fn:f:calls"), ("e:f->a", "f", "a")], "id string, source string, target string").mapInArrow(rows, "id string, source string, target string")
    edges = calls.unionByName(plain.select("id", "source", "target", F.lit("contains").alias("kind"), F.lit(False).alias("hot")))
    turns = [("e:a->b:calls", "enter"), ("e:a->b:calls", "enter"), ("e:b->c:calls", "enter"), ("e:b->c:calls", "exit"), ("e:x->y:calls", "enter"), (None, "enter"), ("e:f->fn:f:calls", "enter"), ("e:f->a", "enter")]
    hot = lambda some: events(spark, [{"event": "hotedge", "edge": e, "state": s} for e, s in some])
    assert sorted((r.edge, r.hot) for r in overlay.edge_heat(hot(turns[:4]), edges).collect()) == [("e:a->b:calls", True), ("e:b->c:calls", False)]
    assert [(r.seq, r.edge, r.hot) for r in overlay.coalesce_hot_transitions(hot(turns[:4]), edges).orderBy("seq").collect()] == [(0, "e:a->b:calls", True), (3, "e:b->c:calls", False)]
    assert made.value == 0
    assert sorted((r.edge, r.hot) for r in overlay.edge_heat(hot(turns), edges).collect()) == [("e:a->b:calls", True), ("e:b->c:calls", False), ("e:f->a", True), ("e:f->fn:f:calls", True)]
    assert [(r.seq, r.hot) for r in overlay.coalesce_hot_transitions(hot(turns), edges).orderBy("seq").collect()] == [(0, True), (3, False), (6, True), (7, True)]


def test_activity_gives_four_three_two(spark):
    ev = events(spark, [act(0), act(10, pid=2), act(20), act(30, agent=None)])
    counts = {r.seq: r.n for r in overlay.expand_activity(ev).groupBy("seq").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 4, 1: 3, 2: 2}


def test_roster_ages(spark):
    ev = events(spark, [act(0), act(0, pid=2)])
    at = lambda ms: {r.pid: r.status for r in overlay.roster_at(ev, F.timestamp_millis(F.lit(ms))).collect()}
    assert at(5000) == {1: "active", 2: "active"} and at(5001) == {1: "inactive", 2: "inactive"} and len(at(60000)) == 2 and at(60001) == {}


def test_throttle(spark):
    rows = spark.createDataFrame([(i, i // 100, "e", "enter" if i % 2 == 0 else "exit") for i in range(5000)], "seq long, ts_ms long, edge string, state string").withColumn("ts_ms", F.lit(5))
    got = overlay.throttle(rows).collect()
    assert sorted(r.seq for r in got) == [0, 1, 2]


def test_debounce(spark):
    rows = [("r", "a", 0), ("r", "a", 100), ("r", "b", 249), ("r", "c", 399)] + [("q", f"p{i % 3}", 100 * i) for i in range(25)]
    got = overlay.debounce(spark.createDataFrame(rows, "root string, path string, ts_ms long")).collect()
    assert {(r.burst_start, r.path) for r in got if r.root == "r"} == {(0, "a"), (0, "b"), (399, "c")}
    assert sorted({r.burst_start for r in got if r.root == "q"}) == [0, 1000, 2000]


def test_metrics(spark):
    env = spark.createDataFrame([(0, "x"), (1, "x"), (4001, "x"), (4002, "metrics.update")], "ts_ms long, type string")
    assert [tuple(r) for r in metrics.metrics_windows(env).orderBy("window_ms").collect()] == [(0, 2, 1000), (2000, 0, 0), (4000, 1, 500)]
    roster = spark.createDataFrame([(2, "a", "#2", "inactive", 1), (1, "a", "#1", "active", 5)], "pid long, agent string, color string, status string, first_seq long")
    assert [tuple(r) for r in metrics.roster_by_agent(roster).collect()] == [("a", True, "#2")]
    assert [a.pid for a in metrics.roster_envelope(roster).first().agents] == [1, 2]
    assert metrics.roster_envelope(roster.limit(0)).count() == 0


RUST = """//! File docs
//! more

/// Adds.
///  twice
pub fn add(&self, a: i32, b: Vec<u8>) -> i32 {
    let x = inner();
    let (p, mut q) = pair();
    if a > 0 {
        let hidden = 1;
    }
    outer(x);
    outer(inner());
    self.method();
    x
}

fn inner() -> i32 { 1 }
fn outer(v: i32) {}
"""
PY = 'class A:\n    def run(self, n: int, *args, k=1) -> str:\n        """Runs."""\n        total = n\n        return str(total)\n'
TS = "/**\n * Says.\n */\nexport function say(text: string, loud?: boolean): void {\n  const out = text;\n}\n"


def test_facts(spark):
    files = spark.createDataFrame([("a.rs", RUST), ("b.py", PY), ("c.ts", TS), ("d.go", "func x() {")], "path string, content string")
    lines = facts.source_lines(files)
    functions = facts.scan_functions(lines)
    assert {(r.path, r.name) for r in functions.collect()} == {("a.rs", "add"), ("a.rs", "inner"), ("a.rs", "outer"), ("b.py", "run"), ("c.ts", "say")}
    sig = {r.name: r.signature for r in facts.scan_signatures(functions).collect()}
    assert [(p.name, p.type) for p in sig["add"].params] == [("a", "i32"), ("b", "Vec<u8>")] and sig["add"].returns == "i32"
    assert [(p.name, p.type) for p in sig["run"].params] == [("n", "int")] and sig["run"].returns == "str"
    assert [(p.name, p.type) for p in sig["say"].params] == [("text", "string"), ("loud", "boolean")] and sig["say"].returns == "void"
    docs = {r.name: r.docs for r in facts.scan_docs(lines, functions).collect()}
    assert docs == {"add": "Adds.\n twice", "run": "Runs.", "say": "Says."}
    assert {(r.path, r.docs) for r in facts.file_docs(lines).collect()} == {("a.rs", "File docs\nmore")}
    variables = {(r.fn, r.var) for r in facts.scan_variables(lines).collect()}
    assert variables == {("add", "x"), ("add", "p"), ("add", "q"), ("run", "total"), ("say", "out")}
    calls = {(r.caller, r.callee) for r in facts.resolve_calls(facts.scan_calls(lines), functions).collect()}
    assert calls == {("add", "inner"), ("add", "outer")}
    nodes, edges = facts.build_graph(files)
    kinds = {(r.kind, r.source, r.target) for r in edges.where("kind in ('data_flows_from', 'param_source')").collect()}
    assert kinds == {("data_flows_from", "fn:a.rs:inner", "fn:a.rs:outer"), ("param_source", "fn:a.rs:outer", "fn:a.rs:inner")}
    assert {r.id for r in nodes.where("type = 'file'").collect()} == {"file:a.rs", "file:b.py", "file:c.ts", "file:d.go"}


def test_broken_rust_keeps_its_file_only(spark):
    nodes, edges = facts.build_graph(spark.createDataFrame([("x.rs", "fn a() {\n")], "path string, content string"))
    assert [(r.id, r.status) for r in nodes.collect()] == [("file:x.rs", "error")] and edges.count() == 0


def bursts(rows, quiet, most):
    out = set()
    for root in {r for r, _, _ in rows if r is not None}:
        mine = sorted((t, p) for r, p, t in rows if r == root and t is not None)
        start = last = None
        held = []
        for t, p in [*mine, (10**15, None)]:
            if last is not None and (t - last >= quiet or t - start >= most):
                out |= {(root, start, last, q) for q in held}
                start, held = None, []
            start = t if start is None else start
            last = t
            held.append(p)
    return out


@pytest.mark.parametrize("width", [50, 200, 100_000])
def test_bursts_over_ranges_against_a_walk(spark, width):
    """Long runs without a gap over many ranges, empty ranges, changes of one time, and the cap falling anywhere."""
    rng = random.Random(width)
    rows = [(None, "p", 3), ("r", "q", None)]
    for root, steps in (("dense", [1, 2, 3, 5]), ("mixed", [1, 4, 9, 11, 30]), ("sparse", [5, 19, 60, 400]), ("even", [7])):
        t = rng.randrange(-500, 500)
        for _ in range(400):
            t += rng.choice(steps)
            rows += [(root, f"p{rng.randrange(4)}", t) for _ in range(rng.randint(1, 2))]
    for quiet, most in ((10, 50), (20, 37), (6, 50)):
        got = [tuple(r) for r in overlay.debounce(spark.createDataFrame(rows, "root string, path string, ts_ms long"), quiet, most, width).select("root", "burst_start", "burst_end", "path").collect()]
        assert len(got) == len(set(got)) and set(got) == bursts(rows, quiet, most)


CODE = {
    "a.rs": 'fn one(\n    a: i32, // the first (\n    b: &str,\n) -> Vec<u8>\nwhere\n    u8: Copy,\n{\n    let s = "(((\n  fn no(";\n    let c = \'(\'; /* [[ /* {{ */\n fn never( */\n}\nfn two(&self, x: u8) -> u8 { x }\n',
    "b.py": 'def one(\n    self,\n    a: int,  # ]\n    b: str,\n) -> int:\n    """Doc ((\n    """\n    return \'{\'\ndef two(): pass\n',
    "c.ts": "export function one(\n  a: number,\n  b: string,\n): Promise<void> {\n  const t = `((\n [`;\n}\n",
    "d.rs": "fn a() {\n",
    "e.rs": 'fn a() { "no end }\n',
    "f.py": "x = (1,\n",
    "g.ts": "/* no end\n",
    "h.txt": "(((",
    "i.rs": "fn l<'a>(x: &'a str) -> &'a str { x } // '\n",
    "j.rs": 'fn r() { r#"a " ("#; "\\""; \'\\\'\'; }\n',
    "k.py": "'''ok ('''\n'it\\'s ('\n#\n",
    "l.py": '"""no end (\n',
}


def test_code_over_several_lines(spark):
    lines = facts.source_lines(spark.createDataFrame(list(CODE.items()), "path string, content string"))
    rows = lines.orderBy("path", "line_no").collect()
    for r in rows:
        assert len(r.text) == len(r.code), r
    for path, content in CODE.items():
        assert "\n".join(r.text for r in rows if r.path == path) == content
    status = {r.path: r.status for r in facts.file_status(lines).collect()}
    assert status == {p: "error" if p[0] in "defgl" else "unknown" for p in CODE}
    found = {(r.path, r.name): r.signature for r in facts.scan_signatures(facts.scan_functions(lines.where("path in ('a.rs', 'b.py', 'c.ts')"))).collect()}
    params = {k: [(p["name"], p["type"]) for p in s.params] for k, s in found.items()}
    assert params == {("a.rs", "one"): [("a", "i32"), ("b", "&str")], ("a.rs", "two"): [("x", "u8")], ("b.py", "one"): [("a", "int"), ("b", "str")], ("b.py", "two"): [], ("c.ts", "one"): [("a", "number"), ("b", "string")]}
    assert {k: found[k].returns for k in params} == {("a.rs", "one"): "Vec<u8>", ("a.rs", "two"): "u8", ("b.py", "one"): "int", ("b.py", "two"): "", ("c.ts", "one"): "Promise<void>"}
    nodes, _ = facts.build_graph(spark.createDataFrame(list(CODE.items()), "path string, content string"))
    built = {r.id: r for r in nodes.collect()}
    assert [p["name"] for p in built["fn:a.rs:one"].signature.params] == ["a", "b"] and built["var:a.rs:one:s"].parent_id == "fn:a.rs:one"
    assert {i for i in built if i.startswith("fn:")} == {"fn:a.rs:one", "fn:a.rs:two", "fn:b.py:one", "fn:b.py:two", "fn:c.ts:one", "fn:i.rs:l", "fn:j.rs:r"} and built["file:d.rs"].status == "error"


def test_targets_whose_ids_share_forms_or_lack_them(spark):
    """Events are read twice at most, ids of forms that no event names are left out before they are gathered, and what needs no target or names none stays as before."""
    nodes = spark.createDataFrame([("fn:a:b", "file:a"), ("fn:a:b", "file:z"), ("plain", "file:a"), ("var:a:b:c", "fn:a:b"), (None, "file:a"), ("e:odd", "file:a")], "id string, parent_id string")
    edges = spark.createDataFrame([("e:fn:a:b->fn:a:c:calls",), ("odd",), ("e:x->y",), ("e:x->y",), (None,)], "id string")
    rows = [("test", "fn:a:b", None), ("status", "plain", None), ("test", "fn:none", None), ("test", None, None), ("test", "e:odd", None), ("hotedge", None, "e:fn:a:b->fn:a:c:calls"), ("hotedge", None, "odd"), ("hotedge", None, "e:x->y"),
            ("hotedge", None, "e:x->z:calls"), ("hotedge", "fn:a:b", None), ("activity", "fn:none", None), ("activity", None, None), (None, "fn:a:b", None), ("test", "odd", None), ("hotedge", None, "plain")]
    events = spark.createDataFrame([(i, *r, "pass" if i % 2 else "fail") for i, r in enumerate(rows)], "seq long, event string, node string, edge string, outcome string")
    met = overlay.match_targets(events, nodes, edges)
    assert met.columns == events.columns and sorted(r.seq for r in met.collect()) == [0, 1, 4, 5, 6, 7, 10, 11]
    assert {tuple(r) for r in overlay.latest_status(events, nodes).collect()} == {("fn:a:b", "failing"), ("plain", "passing"), ("e:odd", "failing")}
    assert {tuple(r)[:3] for r in overlay.status_board(events, nodes).collect()} == {("file:a", 1, 2), ("file:z", 0, 1)}
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 3  # events, nodes and edges once each


def test_variables_sort_no_line_that_binds_nothing(spark):
    """Plain lines don't reach the sort, and what is found stays the same beside them."""
    plain = "\n".join(f"    call({i});" for i in range(200))
    files = spark.createDataFrame([("a.rs", "fn f() {\n" + plain + "\n    let x = 1;\n    if y {\n        let z = 2;\n    }\n    let (p, q) = w;\n}\nlet no = 3;"), ("b.py", "def g():\n    t = 1\n    call()\n\nu = 2")], "path string, content string")
    lines = facts.source_lines(files)
    assert {tuple(r) for r in facts.scan_variables(lines).collect()} == {("a.rs", "f", 202, "x"), ("a.rs", "f", 206, "p"), ("a.rs", "f", 206, "q"), ("b.py", "g", 2, "t")}
    kept = facts._enclosed(lines, ["text"], facts.F.lit(False))
    assert kept.count() == 5 and {tuple(r) for r in facts.scan_variables(facts.enclosing(lines)).collect()} == {tuple(r) for r in facts.scan_variables(lines).collect()}
