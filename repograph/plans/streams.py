"""Registered queries of the continuous forms: events go out as log files or tables, come back as streams, and what the streams wrote is returned.

All events of a key are written by one task in their order, so a query doesn't depend on how files are dealt to batches. Folders are made in the session's shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, overlay
from ..sources import events as E
from ..streaming import live
from .catalog import _STATUS, _VALID, DAY, query

#: Keyed state needs this store.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000


def _folder(spark: SparkSession) -> str:
    return f"{graph.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _run(spark: SparkSession, start) -> None:
    """Starts a query with the store for keyed state, waits for its end and puts the session's setting back."""
    name, value = _PROVIDER
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        start().awaitTermination()
    finally:
        spark.conf.set(name, before)


def _replayed(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives until its input ends."""
    spark = stream.sparkSession
    out = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    _run(spark, out.start)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _streamed(df: DataFrame, folder: str, files: int = 1 << 20) -> DataFrame:
    """The rows of ``df`` as a stream of at most ``files`` files a batch."""
    df.write.parquet(f"{folder}/in")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")


def _log(v, folder: str) -> str:
    """The tagged lines as log files; those of a node or an edge stand in one file, in order."""
    key = v("clv_events").select("seq", F.coalesce("node", "edge", F.col("seq").cast("string")).alias("key"))
    v("tagged").join(key, "seq").repartition("key").sortWithinPartitions("seq").select("value").write.text(f"{folder}/log")
    return f"{folder}/log"


@query(_STATUS.replace("WHERE", f"WHERE {_VALID} AND"))
def logged_status(v):
    """From closed log files to the last status of each node, in the order that the log gives."""
    nodes = v("graph_nodes")
    lines = E.read_tagged_log(nodes.sparkSession, _log(v, _folder(nodes.sparkSession)))
    return overlay.latest_status(E.decode_tagged_lines(lines), nodes)


_TOLD = f"SELECT node, count(*) AS n, CASE arg_max(outcome, seq) WHEN 'pass' THEN 'passing' ELSE 'failing' END AS status FROM clv_events WHERE {_VALID} AND event = 'test' AND node IN (SELECT id FROM graph_nodes) GROUP BY node"


@query(_TOLD)
def streamed_status(v):
    """From a followed log folder through the strict decoder to the live statuses: how many each node had, and the last."""
    nodes = v("graph_nodes")
    folder = _folder(nodes.sparkSession)
    lines = E.read_tagged_log(nodes.sparkSession, _log(v, folder), streaming=True)
    told = _replayed(live.live_status(E.decode_tagged_lines(lines), nodes), folder)
    return told.groupBy("node").agg(F.count("*").alias("n"), F.max_by("status", "seq").alias("status"))


@query(f"""SELECT edge, count(*) AS changes, arg_max(hot, seq) AS hot FROM (SELECT seq, edge, state = 'enter' AS hot, coalesce(lag(state = 'enter') OVER (PARTITION BY edge ORDER BY seq), false) AS was
           FROM clv_events WHERE {_VALID} AND event = 'hotedge' AND edge IN (SELECT id FROM graph_edges)) WHERE hot <> was GROUP BY edge""")
def streamed_heat(v):
    """From a followed log folder to the changes of each call edge's heat."""
    edges = v("graph_edges").where("kind = 'calls'")
    folder = _folder(edges.sparkSession)
    lines = E.read_tagged_log(edges.sparkSession, _log(v, folder), streaming=True)
    told = _replayed(live.live_heat(E.decode_tagged_lines(lines), edges), folder)
    return told.groupBy("edge").agg(F.count("*").alias("changes"), F.max_by("hot", "seq").alias("hot"))


_OWN = """SELECT pid, agent, at_ms, lag(agent) OVER w AS was, lag(at_ms) OVER w AS was_ms, lead(at_ms) OVER w AS next_ms
          FROM (SELECT pid, agent, ts, seq, epoch_us(ts) // 1000 AS at_ms FROM clv_events WHERE event = 'activity') WINDOW w AS (PARTITION BY pid ORDER BY ts, seq)"""
_CUTOFF = 1_705_708_800_000  # 2024-01-20


@query(f"""SELECT pid, agent, status, at_ms FROM (SELECT pid, agent, 'active' AS status, at_ms FROM ({_OWN}) WHERE was IS NULL OR was <> agent OR at_ms - was_ms > {DAY}
           UNION ALL SELECT pid, agent, 'inactive', at_ms + {DAY} + 1 FROM ({_OWN}) WHERE next_ms IS NULL OR next_ms - at_ms > {DAY}) WHERE at_ms < {_CUTOFF}""")
def streamed_roster(v):
    """Changes of each process's liveness up to a day, in event time; a process is idle after a day."""
    events = v("clv_events").where("event = 'activity'").select("event", "pid", "agent", "seq", F.col("ts").cast("timestamp"))
    folder = _folder(events.sparkSession)
    told = _replayed(live.live_roster(_streamed(events, folder), DAY, 1000 * DAY), folder)
    return told.where(F.col("at_ms") < _CUTOFF)


@query("SELECT seq, edge, state FROM (SELECT *, row_number() OVER (PARTITION BY edge, state, ts_ms // 100 ORDER BY seq) AS n FROM hot_dense WHERE edge IS NOT NULL) WHERE n <= CASE state WHEN 'enter' THEN 2 ELSE 1 END")
def streamed_throttle(v):
    """The rows that the stream form of throttle lets pass."""
    dense = v("hot_dense").select("seq", "edge", "state", F.timestamp_millis("ts_ms").alias("ts"))
    folder = _folder(dense.sparkSession)
    return _replayed(live.throttle_stream(_streamed(dense, folder)), folder).select("seq", "edge", "state")


@query(f"""WITH per AS (SELECT epoch_us(ts) // 1000 // {HOUR} * {HOUR} AS window_ms, count(*) AS n FROM flat_envelopes WHERE session NOT LIKE '%-1_' GROUP BY 1)
           SELECT w.window_ms, coalesce(c.n, 0) AS n, coalesce(c.n, 0) * 1000000 // {HOUR} AS events_per_sec_milli FROM (SELECT unnest(range(min(window_ms), {_CUTOFF} + 86400000, {HOUR})) AS window_ms FROM per) w LEFT JOIN per c ON w.window_ms = c.window_ms""")
def streamed_windows(v):
    """Rates per hour from the first event up to a day; the days 10 to 19 of each month are left out of the input, so their hours are quiet."""
    told = v("flat_envelopes").where("session not like '%-1_'").select("type", F.col("ts").cast("timestamp"))
    folder = _folder(told.sparkSession)
    return _replayed(live.metrics_stream(_streamed(told, folder), HOUR), folder).where(F.col("window_ms") < _CUTOFF + DAY)


@query("SELECT 'heat' AS sink, session, count(*) AS n FROM clv_events WHERE event = 'hotedge' GROUP BY session UNION ALL SELECT 'tests', session, count(*) FROM clv_events WHERE event = 'test' GROUP BY session")
def fanned_out(v):
    """One stream to two sinks, one of which fails at its first batch and catches up."""
    events = v("clv_events").select("seq", "event", "session")
    spark = events.sparkSession
    folder, tried = _folder(spark), []

    def heat(df: DataFrame, k: int) -> None:
        df.where("event = 'hotedge'").write.mode("overwrite").parquet(f"{folder}/heat/batch={k}")

    def tests(df: DataFrame, k: int) -> None:
        tried.append(k)
        if len(tried) == 1:
            raise OSError("not yet")
        df.where("event = 'test'").write.mode("overwrite").parquet(f"{folder}/tests/batch={k}")

    sinks = {"heat": heat, "tests": tests}
    live.fan_out(_streamed(events, folder, max(spark.sparkContext.defaultParallelism // 2, 1)), sinks, f"{folder}/state").awaitTermination()
    failed = live.deliver(spark, sinks, f"{folder}/state-sinks")  # what the failing sink may still miss
    if failed:
        raise RuntimeError(f"undelivered: {failed}")
    had = [spark.read.schema(events.schema).parquet(f"{folder}/{name}/*").select(F.lit(name).alias("sink"), "session") for name in sinks]
    return had[0].unionByName(had[1]).groupBy("sink", "session").agg(F.count("*").alias("n"))


@query("SELECT 'part=' || CAST(c_custkey % 25 AS VARCHAR) AS folder, path AS line FROM places")
def listed_sources(v):
    """The lines of all source files found below a folder, with the first folder of their relative path."""
    places = v("places")
    root = f"{_folder(places.sparkSession)}/tree"
    places.select((F.col("c_custkey") % 25).alias("part"), F.col("path").alias("value")).write.partitionBy("part").text(root)
    found = E.list_sources(places.sparkSession, root, ("txt",))
    return found.select(F.split("path", "/")[0].alias("folder"), F.explode(F.split(F.regexp_replace("content", r"\n\z", ""), "\n")).alias("line"))
