"""Reading, decoding and encoding of tagged log lines and envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ENVELOPE_TYPES, EVENT, MOST_LONG, MOST_PID, OUTCOMES
from .tail import followed_lines

#: Fixed value: the mark that opens a tagged line, with its space.
TAG = "#CLV1 "


def read_tagged_log(spark: SparkSession, path: str, streaming: bool = False, max_line_bytes: int = 65536) -> DataFrame:
    """Lines (column value) of log files with their total order seq; longer lines are dropped, a trailing carriage return too, invalid UTF-8 is replaced.

    Closed files are read in batch by Spark's own text source: seq is a struct of time and path of the file, the first byte of the block and the line's place in what its task reads, which
    follows the block. A stream follows growing files (see ``tail``): seq is a decimal, and ts, file come with it.
    """
    if streaming:
        return followed_lines(spark, path, True, max_line_bytes)
    lines = spark.read.format("text").option("lineSep", "\n").load(path)
    place = F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    own = lines.select(place.alias("seq"), "value")
    return own.where(F.octet_length("value") <= max_line_bytes).select("seq", F.make_valid_utf8(F.regexp_replace("value", r"\r\z", "")).alias("value"))


def _string(name: str, required: bool) -> Column:
    """Whether a field of the single parsed object is a string; an optional one may be missing or null."""
    kind = F.schema_of_variant(F.try_variant_get("_w", f"$[0].{name}", "variant"))
    return (kind == "STRING") if required else (kind.isNull() | kind.isin("VOID", "STRING"))


def decode_tagged_lines(lines: DataFrame, tag: str = TAG) -> DataFrame:
    """Typed events of the lines (column value, others kept) that are exactly one well-formed object of a known kind; all else is dropped.

    Strict where Spark's reader is lax: trailing text, duplicate keys, single quotes and values of another type reject a line.
    """
    body = lines.where(F.startswith("value", F.lit(tag))).withColumn("_body", F.expr(f"substring(value, {len(tag) + 1})"))
    options = {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}
    parsed = body.withColumn("_j", F.from_json("_body", EVENT + ", _bad string", options)).withColumn("_w", F.try_parse_json(F.concat(F.lit("["), "_body", F.lit("]"))))
    one = F.col("_j").isNotNull() & F.col("_j._bad").isNull() & F.col("_w").isNotNull() & (F.size(F.try_variant_get("_w", "$", "array<variant>")) == 1)
    event = F.col("_j.event")
    word = lambda c: F.col(f"_j.{c}").isin(*OUTCOMES)
    duration = F.schema_of_variant(F.try_variant_get("_w", "$[0].durationMs", "variant"))
    whole = duration.isNull() | (duration == "VOID") | ((duration.startswith("BIGINT") | duration.startswith("DECIMAL(20,0)")) & (F.col("_j.durationMs") >= 0) & (F.col("_j.durationMs") <= F.lit("18446744073709551615").cast("decimal(20,0)")))
    shape = (
        F.when(event == "activity", _string("node", True) & _string("action", True) & _string("agent", False))
        .when(event == "test", _string("node", True) & word("outcome") & _string("agent", False) & _string("msg", False) & whole)
        .when(event == "status", _string("node", True) & word("outcome") & _string("agent", False))
        .when(event == "hotedge", _string("edge", True) & _string("state", True) & _string("agent", False))
        .otherwise(F.lit(False))
    )
    pid = F.col("_j.pid").isNull() | F.col("_j.pid").between(0, MOST_PID)
    good = parsed.where(one & _string("event", True) & _string("session", True) & shape & pid)
    fields = [F.col(f"_j.{c}").alias(c) for c in ("event", "session", "pid", "agent", "node", "action", "outcome", "msg", "edge", "state")]
    clamped = F.least(F.col("_j.durationMs"), F.lit(MOST_LONG).cast("decimal(20,0)")).cast("long").alias("duration_ms")
    kept = [c for c in lines.columns if c != "value"]
    return good.select(*kept, *fields, clamped)


_ROW = "struct<processId: bigint, agentId: string, agentType: string, color: string, status: string, protocolVersion: string>"
PAYLOAD = f"nodeId string, testId string, outcome string, status string, sessionId string, agentId string, action string, edgeId string, state string, processId bigint, durationMs bigint, id string, agents array<{_ROW}>, ts string, nodeCount double, edgeCount double, memoryBytes double, eventsPerSecMilli double, parseLatency array<struct<filePath: string, durationUs: double>>, parentId string"


def decode_envelopes(lines: DataFrame) -> DataFrame:
    """(type, session_id, ts, payload, others) of the JSON lines (column value) whose type is accepted and whose payload has that type's shape."""
    parsed = lines.withColumn("_v", F.try_parse_json("value"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
    text = lambda path: kind(f"$.payload.{path}") == "STRING"
    number = lambda k: k.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    every = lambda path, test: (kind(f"$.payload.{path}").startswith("ARRAY")) & F.forall(F.try_variant_get("_v", f"$.payload.{path}", "array<variant>"), test)
    of = lambda row, path: F.schema_of_variant(F.try_variant_get(row, path, "variant"))
    agent = lambda a: F.coalesce(number(of(a, "$.processId")), F.lit(False)) & F.coalesce((of(a, "$.agentId") == "STRING") & (of(a, "$.agentType") == "STRING") & (of(a, "$.color") == "STRING") & (of(a, "$.status") == "STRING"), F.lit(False))
    latency = lambda a: F.coalesce((of(a, "$.filePath") == "STRING") & number(of(a, "$.durationUs")), F.lit(False))
    name = F.try_variant_get("_v", "$.type", "string")
    shape = (
        F.when(name == "test.result", text("nodeId") & text("outcome"))
        .when(name == "status.update", text("nodeId") & text("status"))
        .when(name == "hot_edge", text("edgeId") & F.try_variant_get("_v", "$.payload.state", "string").isin("enter", "exit"))
        .when(name == "agent.roster", every("agents", agent))
        .when(name == "agent.activity", text("agentId") & text("action") & text("nodeId"))
        .when(name == "metrics.update", text("sessionId") & text("ts") & number(kind("$.payload.nodeCount")) & number(kind("$.payload.edgeCount")) & number(kind("$.payload.memoryBytes")) & number(kind("$.payload.eventsPerSecMilli")) & every("parseLatency", latency))
        .otherwise(F.lit(True))
    )
    good = parsed.where((kind("$.type") == "STRING") & name.isin(*ENVELOPE_TYPES) & kind("$.payload").startswith("OBJECT") & F.coalesce(shape, F.lit(False)))
    kept = [c for c in lines.columns if c != "value"]
    payload = F.from_json(F.try_variant_get("_v", "$.payload", "string"), PAYLOAD)
    return good.select(*kept, name.alias("type"), F.try_variant_get("_v", "$.sessionId", "string").alias("session_id"), F.try_variant_get("_v", "$.ts", "string").alias("ts"), payload.alias("payload"))


def encode_envelopes(envelopes: DataFrame) -> DataFrame:
    """JSON lines (column value) of envelopes (type, session_id, ts text, payload struct in camel case); absent fields are left out."""
    return envelopes.select(F.to_json(F.struct(F.lit(1).alias("v"), "ts", F.col("session_id").alias("sessionId"), "type", "payload"), {"ignoreNullFields": "true"}).alias("value"))


def encode_hotedge_lines(events: DataFrame, tag: str = TAG) -> DataFrame:
    """Tagged lines (column value) of call-edge events (session, edge, state)."""
    return events.select(F.concat(F.lit(tag), F.to_json(F.struct(F.lit("hotedge").alias("event"), "session", "edge", "state"))).alias("value"))


def structured_only(envelopes: DataFrame) -> DataFrame:
    """Without what is never stored."""
    return envelopes.where(~F.col("type").isin("snapshot", "subtree", "metrics.update"))


def list_sources(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("rs", "py", "ts"), streaming: bool = False) -> DataFrame:
    """(path, content) of the source files below a folder; files that aren't UTF-8 are skipped, paths are relative."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if streaming else spark.read
    found = reader.format("binaryFile").option("recursiveFileLookup", True).load(root)
    named = found.where(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*extensions)).withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return named.where("text is not null").select(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", ""), f"^\\Q{base}\\E/", "").alias("path"), F.col("text").alias("content"))
