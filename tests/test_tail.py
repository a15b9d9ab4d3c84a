"""Following growing logs: whole lines once and in order, through restarts, truncation and long lines; and on into the live folds."""

import json

import pytest
from pyspark.sql import functions as F

from repograph.operators import overlay
from repograph.sources import events as E
from repograph.sources import tail
from repograph.streaming import live


def run(df, folder, name):
    df.writeStream.format("parquet").option("path", str(folder / name)).option("checkpointLocation", str(folder / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(folder / name)).orderBy("seq").collect()


def add(path, data):
    path.parent.mkdir(exist_ok=True)
    with path.open("ab") as f:
        f.write(data)


def test_lines_are_read_once_and_in_order(spark, tmp_path):
    log = tmp_path / "log"
    lines = lambda: [r.value for r in run(E.read_tagged_log(spark, str(log), streaming=True, max_line_bytes=20), tmp_path, "out")]
    assert lines() == []  # the folder comes later
    add(log / "a.log", b"one\ntwo\nthr")
    add(log / "_hidden", b"no\n")
    assert lines() == ["one", "two"]  # a line that is still written waits
    add(log / "a.log", b"ee\r\n" + b"x" * 20 + b"\n" + b"y" * 21 + b"\n")
    add(log / "b.log", b"bee \xff\n")
    want = ["one", "two", "three", "x" * 20, "bee �"]
    assert lines() == want and lines() == want
    add(log / "a.log", b"z" * 500)
    assert lines() == want
    add(log / "a.log", b"z" * 500 + b"\nafter\n")
    assert lines() == [*want, "after"]  # a line over the cap goes over several batches
    (log / "a.log").write_bytes(b"anew\n")
    (log / "b.log").unlink()
    assert lines() == [*want, "after", "anew"]


@pytest.mark.parametrize("most", [1, 3, 7, 64, 1 << 20])
def test_ranges_split_lines_nowhere(tmp_path, most):
    data = b"a\n\nlong line here\n" + b"w" * 300 + b"\nq\nlast"
    (tmp_path / "f").write_bytes(data)
    want = [(data.index(x) if x else 2, x.decode()) for x in (b"a", b"", b"long line here", b"q\n", b"last")]
    want = [(p, v.strip()) for p, v in want]
    for block in (1, 5, 4096):
        got = []
        for r in tail._ranges(str(tmp_path), {}, tail._files(str(tmp_path)), 0, most):
            for batch in tail._lines(str(tmp_path), r, 100, block):
                got += [(int(s), v) for s, v in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())]
        assert got == want, (most, block)


def test_offsets_number_batches_in_order(tmp_path):
    s = tail.LineStream({"path": str(tmp_path)})
    add(tmp_path / "f", b"a\n")
    first = s.latestOffset()
    assert s.latestOffset() == first and json.loads(json.dumps(first)) == first
    add(tmp_path / "f", b"b\n")
    second = s.latestOffset()
    assert second["at"] > first["at"] and [(r.start, r.stop) for r in s.partitions(first, second)] == [(2, 4)]
    with pytest.raises(ValueError):
        s.partitions(second, {**first, "at": second["at"]})
    again = tail.LineStream({"path": str(tmp_path)})  # after a restart the first plan repeats the last one, then time goes on
    assert again.partitions(second, again.latestOffset()) == []


def test_a_followed_log_folds_like_its_batch(spark, tmp_path):
    log, told = tmp_path / "log", []
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(5)], "id string")
    edges = spark.createDataFrame([(f"e{i}", i % 2 == 0) for i in range(3)], "id string, hot boolean")
    for batch in range(3):
        for k in range(30):
            i = batch * 30 + k
            event = {"event": "test", "session": "s", "node": f"n{i * 7 // 2 % 6}", "outcome": ["pass", "fail", "skip", "running"][i * 5 // 2 % 4]} if i % 2 else {"event": "hotedge", "session": "s", "edge": f"e{i % 4}", "state": ["enter", "exit"][i * 3 % 5 % 2]}
            add(log / f"{i % 3}.log", b"noise\n#CLV1 {broken\n#CLV1 " + json.dumps(event).encode() + b"\n")
        decoded = E.decode_tagged_lines(E.read_tagged_log(spark, str(log), streaming=True))
        told = run(live.live_status(decoded, nodes), tmp_path, "status")
        heat = run(live.live_heat(decoded, edges), tmp_path, "heat")
        run(decoded, tmp_path, "events")
        whole = spark.read.schema(decoded.schema).parquet(str(tmp_path / "events"))
        last = {}
        for r in told:
            last[r.node] = r.status
        assert last == {r.node: r.status for r in overlay.latest_status(whole, nodes).collect()} and len(last) == 5
        hot = {e: i % 2 == 0 for i, e in enumerate(("e0", "e1", "e2"))}
        for r in heat:
            assert hot[r.edge] != r.hot
            hot[r.edge] = r.hot
        for r in overlay.edge_heat(whole, edges).collect():
            assert hot[r.edge] == r.hot
    assert whole.count() == 90 and whole.select(F.countDistinct("seq")).first()[0] == 90
