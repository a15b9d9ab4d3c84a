from pyspark.sql import functions as F

from repograph.operators import facts


def test_files_are_lexed_once_for_headers(spark):
    """Reading whole headers takes one pass over the lines, and plain code is taken in long pieces."""
    text = 'fn one(\n    a: i32, // (\n) -> i32\n{ "(" }\n#[x]\nfn r2(b: u8) -> u8 { for"}" }\n'
    files = spark.createDataFrame([("a.rs", text)], "path string, content string")
    found = facts.scan_functions(facts.source_lines(files))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("arrays_zip(") == 1
    assert {(r.name, r.language, r.line_no, r.text) for r in found.collect()} == {("one", "rust", 1, 'fn one( a: i32, ) -> i32 { "(" }'), ("r2", "rust", 6, 'fn r2(b: u8) -> u8 { for"}" }')}
    code = files.select(facts.code_of(F.col("content"), F.lit("rust")).alias("c")).first().c
    assert code == 'fn one(\n    a: i32,     \n) -> i32\n{ " " }\n [x]\nfn r2(b: u8) -> u8 { for" " }\n'
