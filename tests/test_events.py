import pytest

from repograph.sources import events as E

GOOD = [
    '{"event":"activity","session":"s","node":"n","action":"modified","pid":4294967295,"agent":"a"}',
    '{"event":"test","session":"s","node":"n","outcome":"fail","durationMs":12}',
    '{"event":"test","session":"s","node":"n","outcome":"pass","durationMs":18446744073709551615}',
    '{"event":"status","session":"s","node":"n","outcome":"running","other":[1]}',
    '{"event":"hotedge","session":"s","edge":"e","state":"odd"}',
]
BAD = [
    "{not json", "", '{"event":"bogus","session":"s","node":"n"}', '{"session":"s","node":"n"}', '{"event":"test","node":"n","outcome":"fail"}', '{"event":"activity","session":"s","action":"m"}',
    '{"event":"test","session":"s","outcome":"fail"}', '{"event":"status","session":"s","outcome":"running"}', '{"event":"hotedge","session":"s","state":"enter"}', '["event","test"]', "42",
    '{"event":"test","session":"s","node":"n","outcome":"maybe"}', '{"event":"test","session":"s","node":"n","outcome":"pass"} x', '{"event":"test","session":"s","node":7,"outcome":"pass"}',
    '{"event":"test","session":"s","node":"n","outcome":"pass","pid":-1}', '{"event":"test","session":"s","node":"n","outcome":"pass","durationMs":1.5}', "{'event':'status','session':'s','node':'n','outcome':'pass'}",
    '{"event":"status","session":"s","session":"t","node":"n","outcome":"pass"}', '{"event":"status","session":null,"node":"n","outcome":"pass"}',
]


def test_decode_is_strict(spark):
    rows = [(i, "#CLV1 " + b) for i, b in enumerate(GOOD + BAD)] + [(100, "#CLV1" + GOOD[0]), (101, GOOD[0]), (102, "PASS app"), (103, None)]
    got = E.decode_tagged_lines(spark.createDataFrame(rows, "seq int, value string")).collect()
    assert sorted(r.seq for r in got) == list(range(len(GOOD)))
    by = {r.seq: r for r in got}
    assert by[0].pid == 4294967295 and by[1].duration_ms == 12 and by[2].duration_ms == 9223372036854775807


def test_line_cap_and_line_ends(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"x" * 65536 + b"\n" + b"y" * 65537 + b"\nwin\r\nlast")
    got = {r.value for r in E.read_tagged_log(spark, str(tmp_path)).collect()}
    assert got == {"x" * 65536, "win", "last"}


def test_hotedge_round_trip(spark):
    rows = spark.createDataFrame([("s", 'e:"a"->b', "enter")], "session string, edge string, state string")
    assert [tuple(r) for r in E.decode_tagged_lines(E.encode_hotedge_lines(rows)).select("session", "edge", "state").collect()] == [("s", 'e:"a"->b', "enter")]


@pytest.mark.parametrize("payload,ok", [('{"nodeId":"n","outcome":"pass"}', True), ('{"nodeId":7,"outcome":"pass"}', False), ('"x"', False)])
def test_envelopes(spark, payload, ok):
    df = spark.createDataFrame([('{"type":"test.result","payload":' + payload + "}",)], "value string")
    assert E.decode_envelopes(df).count() == ok


def test_envelope_rosters_and_unknown_types(spark):
    row = '{"processId":1,"agentId":"a","agentType":"t","color":"#fff","status":"active"}'
    lines = ['{"type":"agent.roster","payload":{"agents":[' + row + "]}}", '{"type":"agent.roster","payload":{"agents":[' + row + ',{"processId":"1"}]}}', '{"type":"agent.roster","payload":{"agents":[]}}', '{"type":"error","payload":{}}', '{"type":"snapshot","payload":{}}', "nope"]
    got = E.decode_envelopes(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "k int, value string")).collect()
    assert sorted(r.k for r in got) == [0, 2, 4]


def test_list_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.rs").write_text("fn a() {}")
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "c.py").write_bytes(b"\xff\xfe")
    assert [(r.path, r.content) for r in E.list_sources(spark, str(tmp_path)).collect()] == [("d/a.rs", "fn a() {}")]
