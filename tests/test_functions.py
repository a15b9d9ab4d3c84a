from pyspark.sql import functions as F

from repograph.functions import scalars as S


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_ids(spark):
    got = one(spark, S.node_id(F.lit("file"), F.lit("a/b.rs"), F.lit("")), S.node_id(F.lit("function"), F.lit("a"), F.lit("f")), S.edge_id(F.lit("x"), F.lit("y")), S.typed_edge_id(F.lit("x"), F.lit("y"), F.lit("calls")), S.type_of_id(F.lit("fn:a:f")))
    assert got == ("file:a/b.rs", "fn:a:f", "e:x->y", "e:x->y:calls", "function")


def test_agent_ids_round_trip(spark):
    names = ["a", "a:b", "a%3Ab", "%", "::%%", ""]
    rows = spark.createDataFrame([(n,) for n in names], "a string").select("a", S.agent_node_id("a").alias("n"), S.bare_agent_id(S.agent_node_id("a")).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and len({r.n for r in rows}) == len(names)


def test_colors(spark):
    got = one(spark, S.agent_color(F.lit("a")), S.agent_color(F.lit("tdd-green")), S.agent_color(F.lit("")))
    assert got == ("#0c292c", "#967edd", "#1c9dc5")


def test_safe_color(spark):
    good = ["#fff", "#A1b2C3", "#a1b2c3d4", "rgb(1,2,3)", "rgba(1, 2, 3, .5)", "rgba(1,2,3,50%)"]
    bad = ["#ffff", "red", "url(x)", "#fff;background:url(x)", "rgb(1,2)", "#fff\n"]
    rows = spark.createDataFrame([(c,) for c in good + bad], "c string").select("c", S.safe_color("c").alias("s")).collect()
    assert [r.s for r in rows] == good + [None] * len(bad)


def test_words_and_sizes(spark):
    got = one(spark, S.status_from_outcome(F.lit("skip")), S.flow_class(F.lit("imports")), S.hot_from_state(F.lit("odd")), S.format_bytes(F.lit(1023)), S.format_bytes(F.lit(1536)), S.events_per_sec(F.lit(4200)), S.language_of(F.lit("x/y.py")), S.file_label(F.lit("x/y.py")), S.docs_or_placeholder(F.lit("")))
    assert got == ("stale", None, None, "1023 B", "1.5 KB", "4.2", "python", "y.py", "No documentation")


def test_json_codec(spark):
    made = F.struct(F.array(F.struct(F.lit("a").alias("name"), F.lit("i32").alias("type"))).alias("params"), F.lit("u8").alias("returns"))
    row = spark.range(1).select(S.signature_from_json(S.signature_json(made)).alias("s"), S.signature_json(F.lit(None).cast("struct<a: int>")).alias("n")).first()
    assert row.s.params[0].name == "a" and row.s.returns == "u8" and row.n is None
