import random

from pyspark.sql import functions as F

from repograph.operators import diff, graph

NODES = [("f", "file", "f.rs", None), ("a", "function", "a", "f"), ("b", "function", "b", "f"), ("v", "variable", "v", "a"), ("agent:x", "agent", "x", None), ("o", "function", "o", "gone")]
EDGES = [("1", "f", "a", "contains", False), ("2", "f", "b", "contains", False), ("3", "a", "v", "contains", False), ("4", "a", "b", "calls", True), ("5", "a", "agent:x", "authored_by", False), ("6", "a", "zz", "data_flows_from", False)]


def frames(spark):
    nodes = spark.createDataFrame(NODES, "id string, type string, label string, parent_id string").selectExpr("*", "cast(array() as array<string>) as child_ids")
    return nodes, spark.createDataFrame(EDGES, "id string, source string, target string, kind string, hot boolean")


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_hierarchy(spark):
    nodes, edges = frames(spark)
    assert ids(graph.root_nodes(nodes)) == ["agent:x", "f"]
    kids, kept = graph.children_of(nodes, edges, "f")
    assert ids(kids) == ["a", "b"] and ids(kept) == ["1", "2"]
    assert graph.children_of(nodes, edges, "none")[0].count() == 0
    below = graph.descendants(nodes, nodes.where("id = 'f'"))
    assert ids(below) == ["a", "b", "v"]
    left, left_edges = graph.collapse(nodes, edges, nodes.where("id = 'a'"))
    assert ids(left) == ["a", "agent:x", "b", "f", "o"] and ids(left_edges) == ["1", "2", "4", "5", "6"]
    owners = {r.id: r.owner for r in graph.owning_file(nodes).collect()}
    assert owners["v"] == "f" and owners["o"] == "o"


def test_cycles_end(spark):
    loop = spark.createDataFrame([("a", "t", "a", "b"), ("b", "t", "b", "a")], "id string, type string, label string, parent_id string")
    assert graph.owning_file(loop).count() == 2
    assert ids(graph.descendants(loop, loop.where("id = 'a'"))) == ["b"]


def test_deep_trees(spark):
    import pytest

    rows = [(f"n{i:02}", "t", "x", f"n{i - 1:02}" if i else None) for i in range(12)]
    deep = spark.createDataFrame(rows, "id string, type string, label string, parent_id string").selectExpr("*", "cast(array() as array<string>) as child_ids")
    names = [r[0] for r in rows]
    assert {r.id: r.owner for r in graph.owning_file(deep).collect()} == {n: "n00" for n in names}
    assert ids(graph.descendants(deep, deep.where("id = 'n00'"))) == names[1:]
    edges = spark.createDataFrame([("1", "n10", "n11", "contains", False)], "id string, source string, target string, kind string, hot boolean")
    left, left_edges = graph.collapse(deep, edges, deep.where("id = 'n00'"))
    assert ids(left) == ["n00"] and ids(left_edges) == []
    assert [(r.row, r.id, r.depth) for r in graph.hierarchy_rows(deep, deep).orderBy("row").collect()] == [(i, n, i) for i, n in enumerate(names)]
    rebuilt, _ = diff.rebuild_graph(deep, edges)
    assert {r.owner_file for r in rebuilt.collect()} == {"n00"}
    for walk in (lambda: graph.owning_file(deep, 4), lambda: graph.descendants(deep, deep.where("id = 'n00'"), 4)):
        with pytest.raises(RuntimeError):
            walk()


def test_rows_in_pre_order(spark):
    nodes, _ = frames(spark)
    rows = graph.hierarchy_rows(nodes, nodes.where("id in ('f', 'b')"), show_agents=False).orderBy("row").collect()
    assert [(r.row, r.id, r.depth, r.expandable, r.expanded) for r in rows] == [(0, "f", 0, True, True), (1, "a", 1, True, False), (2, "b", 1, False, True)]


def test_visibility_and_authors(spark):
    nodes, edges = frames(spark)
    assert ids(graph.visible_edges(edges, nodes)) == ["4"]
    assert ids(graph.visible_edges(edges, nodes, control=False, data=False, agent=True)) == ["5"]
    assert ids(graph.filter_flow(edges, False, False, False)) == []
    assert [tuple(r) for r in graph.agents_for_node(edges).collect()] == [("a", "x")]
    assert [tuple(r) for r in graph.nodes_authored_by(edges, spark.createDataFrame([("x",)], "agent string")).collect()] == [("x", "a")]


def owned(spark, nodes, edges):
    return spark.createDataFrame(nodes, "id string, type string, label string, owner_file string"), spark.createDataFrame(edges or [], "id string, source string, target string, kind string, hot boolean, owner_file string")


def test_diff_and_apply(spark):
    prev = owned(spark, [("f", "file", "f", "f"), ("a", "function", "a", "f"), ("g", "file", "g", "g")], [("1", "f", "a", "contains", False, "f")])
    new = owned(spark, [("f", "file", "f", "f"), ("b", "function", "b", "f"), ("b", "function", "b", "f")], [("2", "f", "b", "contains", False, "f")])
    got = {(r.type, r.id) for r in diff.diff_graph(*prev, *new).collect()}
    assert got == {("node.upsert", "b"), ("edge.upsert", "2"), ("node.remove", "a"), ("edge.remove", "1")}
    assert diff.diff_graph(*prev, *prev).count() == 0
    changes = diff.diff_graph(*prev, *new)
    assert ids(diff.apply_rows(prev[0], new[0], changes, "node")) == ["b", "f", "g"]
    assert ("node.remove", "g") in {(r.type, r.id) for r in diff.diff_graph(*prev, *new, full=True).collect()}
    no_file = owned(spark, [("b", "function", "b", "f")], [])
    assert diff.diff_graph(*prev, *no_file).count() == 0


def test_reconciled_rows_are_those_of_the_changes(spark):
    """Nodes that move between files, that stay with other children, that no file node comes with, and files that weren't parsed."""
    node, edge = "id string, type string, label string, parent_id string", "id string, source string, target string, kind string, hot boolean"
    stored = [("f", "file", "f", None), ("a", "function", "a", "f"), ("b", "function", "b", "f"), ("g", "file", "g", None), ("m", "function", "m", "g"), ("h", "file", "h", None), ("s", "function", "s", "h"), ("x", "agent", "x", None)]
    held = [("1", "f", "a", "contains", False), ("2", "f", "b", "contains", False), ("3", "g", "m", "contains", False), ("4", "h", "s", "contains", False), ("5", "a", "x", "authored_by", False), ("6", "q", "s", "calls", True)]
    new_nodes = [("f", "file", "f", None, "f"), ("a", "function", "a2", "f", "f"), ("m", "function", "m", "f", "f"), ("n", "function", "n", "f", "f"), ("n", "function", "n", "f", "f"), ("o", "function", "o", "k", "k"), ("g", "file", "g", None, "g")]
    new_edges = [("1", "f", "a", "contains", True, "f"), ("7", "f", "n", "contains", False, "f"), ("8", "k", "o", "contains", False, "k")]
    frames_ = [spark.createDataFrame(r, s) for r, s in ((stored, node), (held, edge), (new_nodes, node + ", owner_file string"), (new_edges, edge + ", owner_file string"))]
    nodes, edges, changes = diff.reconcile(*frames_)
    prev = diff.rebuild_graph(*frames_[:2])
    want = diff.diff_graph(*prev, *frames_[2:])
    rows = lambda df, cols: sorted(map(str, df.select(*cols).collect()))
    assert rows(changes, changes.columns) == rows(want, changes.columns)
    for got, old, new, what in ((nodes, prev[0], frames_[2], "node"), (edges, prev[1], frames_[3], "edge")):
        cols = [c for c in old.columns if c != "child_ids"]
        assert rows(got, cols) == rows(diff.apply_rows(old, new, want, what), cols)
    # child_ids of before the changes aren't handed on: f has other children now.
    assert "child_ids" not in nodes.columns and {r.id: r.child_ids for r in graph.with_child_ids(nodes, edges).collect()}["f"] == ["a", "n"]


def test_rebuild_is_a_no_op(spark):
    nodes, edges = frames(spark)
    n, e = diff.rebuild_graph(nodes, edges)
    assert diff.diff_graph(n, e, n, e).count() == 0
    assert {r.id: r.child_ids for r in n.collect()}["f"] == ["a", "b"]
    assert diff.graph_equal(n, n) and not diff.graph_equal(n, n.where("id <> 'a'"))
    assert diff.drop_dangling(nodes, edges).where("id = '6'").count() == 0


def test_a_chain_of_a_thousand_in_twelve_rounds(spark, monkeypatch):
    rows = [(f"n{i:04}", f"n{i - 1:04}" if i else None) for i in range(1000)]
    chain = spark.createDataFrame(rows, "id string, parent_id string").repartition(3)
    rounds, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (rounds.append(1), real(df))[1])
    paths = {r.id: r.path for r in graph.ancestor_paths(chain).collect()}
    assert len(rounds) <= 12
    names = [r[0] for r in rows]
    assert paths == {n: names[: i + 1] for i, n in enumerate(names)}


def test_walks_against_following_parents(spark):
    """Random forests with cycles, self-parents, absent parents and unparented nodes."""
    rng = random.Random(4)
    for n in (1, 7, 40):
        parents = {f"n{i}": rng.choice([None, f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", f"gone{rng.randrange(3)}"]) for i in range(n)}
        nodes = spark.createDataFrame(list(parents.items()), "id string, parent_id string")

        def climb(x):
            path = [x]
            while parents[path[0]] in parents and parents[path[0]] not in path:
                path.insert(0, parents[path[0]])
            return path

        assert {r.id: r.path for r in graph.ancestor_paths(nodes).collect()} == {x: climb(x) for x in parents}
        ids = [*parents, "gone0", "gone1", "never"]
        below = {(a, x) for x in parents for a in [*climb(x)[:-1], parents[climb(x)[0]]] if a in ids and a != x}
        got = [(r.root, r.id) for r in graph.descendants(nodes, spark.createDataFrame([(i,) for i in ids], "id string")).collect()]
        assert len(got) == len(set(got)) and {p for p in got if p[0] != p[1]} == below


def test_equality_counts_rows(spark):
    df = lambda rows: spark.createDataFrame(rows, "a string, b int, c array<string>")
    one = [("x", 1, ["p"]), ("x", 1, ["p"]), (None, None, None), ("1", None, [])]
    assert diff.graph_equal(df(one), df(one[::-1]).repartition(3)) and diff.graph_equal(df([]), df([]))
    assert not diff.graph_equal(df(one), df(one[1:])) and not diff.graph_equal(df(one), df([*one[1:], ("x", 1, ["q"])]))
    assert not diff.graph_equal(df([("1", None, None)]), df([(None, 1, None)])) and not diff.graph_equal(df([(None, 1, [])]), df([(None, 1, None)]))
    assert diff.graph_equal(df(one), df(one).select("c", "b", "a"))


def test_marks_above_against_a_walk(spark):
    """Wide tiers, a chain, a cycle with leaves and absent parents: paths and the marked ancestors of every node."""
    parents = {"r": None, **{f"m{k}": "r" for k in range(4)}, **{f"f{k}": f"m{k % 4}" for k in range(30)}, **{f"v{k}": f"f{k % 30}" for k in range(90)}}
    parents |= {"c0": "gone", **{f"c{k}": f"c{k - 1}" for k in range(1, 9)}, "a": "b", "b": "d", "d": "a", "x": "a", "y": "x"}
    nodes = spark.createDataFrame(list(parents.items()), "id string, parent_id string")
    marked = {"r", "m1", "f2", "f5", "c3", "a", "v7"}
    found = {r["id"]: (r["path"], sorted(r["under"])) for r in graph._climbed(nodes, 100, spark.createDataFrame([(m,) for m in marked], "id string")).collect()}
    for node, up in parents.items():
        path = [node]
        while up in parents and up not in path:
            path.insert(0, up)
            up = parents[up]
        assert found[node] == (path, sorted(set(path[:-1]) & marked))
    assert {r["id"] for r in graph.descendants(nodes, spark.createDataFrame([("gone",), ("f2",)], "id string")).collect()} == {f"c{k}" for k in range(9)} | {"v2", "v32", "v62"}


def test_collapse_joins_edges_once_an_end(spark):
    """Edges from several branches aren't joined branch by branch."""
    nodes = spark.createDataFrame([("r", None), ("f", "r"), ("v", "f")], "id string, parent_id string")
    pairs = [nodes.where("parent_id is not null").select(F.concat("parent_id", F.lit(k), "id").alias("id"), F.col("parent_id").alias("source"), F.col("id").alias("target")) for k in "abc"]
    _, edges = graph.collapse(nodes, pairs[0].unionByName(pairs[1]).unionByName(pairs[2]), spark.createDataFrame([("f",)], "id string"))
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert sorted(r["id"] for r in edges.collect()) == ["raf", "rbf", "rcf"]


def test_collapse_and_rows_against_a_walk(spark):
    """Cycles, absent parents and roots, roots on a cycle; written as columns, at most once what the tree holds."""
    import random

    rng = random.Random(3)
    for _ in range(2):
        names = [f"n{i:02}" for i in range(40)]
        up = {n: rng.choice([None, "gone", *names[: i + 1], *names[max(i - 3, 0) : i + 4]]) for i, n in enumerate(names)}
        marked, opened = set(rng.sample([*names, "gone"], 6)), set(rng.sample(names, 30))

        def above(n):
            out = []
            while (n := up.get(n)) is not None and n not in out:
                out.append(n)
            return out

        nodes = spark.createDataFrame([(n, "t", p) for n, p in up.items()], "id string, type string, parent_id string").selectExpr("*", "cast(array() as array<string>) as child_ids")
        edges = spark.createDataFrame([(f"{a}-{b}", a, b) for a in [*names, "x"] for b in rng.sample(names, 3)], "id string, source string, target string")
        gone = {n for n in names if (set(above(n)) - {n}) & marked}
        left, left_edges = graph.collapse(nodes, edges, spark.createDataFrame([(m,) for m in marked], "id string"))
        assert ids(left) == sorted(set(names) - gone)
        assert ids(left_edges) == sorted(r.id for r in edges.collect() if not {r.source, r.target} & gone)
        rows = graph.hierarchy_rows(nodes, spark.createDataFrame([(n,) for n in opened], "id string")).orderBy("row").collect()
        shows = [n for n in names if up[n] is None or all(a in opened for a in above(n)) and up.get(above(n)[-1], "gone") is None]
        shows.sort(key=lambda n: [*above(n)[::-1], n])
        assert [(r.row, r.id, r.depth, r.expandable, r.expanded) for r in rows] == [(k, n, len(above(n)), n in up.values(), n in opened) for k, n in enumerate(shows)]


def test_rows_walk_only_below_open_nodes(spark, monkeypatch):
    seen = []
    walk = graph._climbed
    monkeypatch.setattr(graph, "_climbed", lambda nodes, *a, **k: (seen.append(nodes.count()), walk(nodes, *a, **k))[1])
    nodes = spark.createDataFrame([("r", "t", None), ("f", "t", "r")] + [(f"v{i}", "t", "f") for i in range(50)], "id string, type string, parent_id string").selectExpr("*", "cast(array() as array<string>) as child_ids")
    assert ids(graph.hierarchy_rows(nodes, nodes.where("id = 'r'"))) == ["f", "r"]
    left, _ = graph.collapse(nodes, nodes.select("id", F.col("id").alias("source"), F.col("id").alias("target")), nodes.where("id = 'f'"))
    assert ids(left) == ["f", "r"] and seen == [2, 2]
