"""The stored tables: folds of the ordered envelope table, and their Parquet store.

A fold by key is a state per key, whose columns are values with their order in front, and the rows of the states. States of parts of a history merge into that of the whole.

Envelopes are flat here: seq, ts (timestamp), type, session (the payload's, for node and edge patches the envelope's), pid, agent, node, edge, status,
outcome, duration_ms, message, action, hot, id, row_node, row_edge, and for roster rows roster (array of struct pid, agent, type, color, status, version).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scalars import meta_from_json, meta_json, signature_from_json, signature_json
from ..operators.graph import cut
from .events import structured_only
from .paths import remove

PERSISTED = ("test.result", "status.update", "hot_edge", "node.upsert", "edge.upsert", "agent.roster", "agent.activity")
PATCHES = ("node.upsert", "node.remove", "status.update", "edge.upsert", "edge.remove", "hot_edge")
ACTING = ("test.result", "status.update", "hot_edge", "agent.activity")


def _rosters(envelopes: DataFrame) -> DataFrame:
    return envelopes.where("type = 'agent.roster'").select("seq", "ts", "session", F.posexplode("roster").alias("_k", "r")).select("seq", "ts", "session", "_k", "r.*")


def session_states(envelopes: DataFrame) -> DataFrame:
    own = envelopes.where(F.col("type").isin(*PERSISTED) & F.col("session").isNotNull())
    return own.groupBy(F.col("session").alias("session_id")).agg(F.min(F.struct("seq", "ts")).alias("first"))


def sessions_of(states: DataFrame) -> DataFrame:
    return states.select("session_id", F.col("first.ts").alias("started_at"), F.lit("").alias("repo_path"))


def fold_sessions(envelopes: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """(session_id, started_at, repo_path): each session at its first stored event; recorded sessions keep their own row."""
    seen = sessions_of(session_states(envelopes))
    return seen if recorded is None else record_sessions(recorded, seen)


def record_sessions(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """``sessions`` with those of ``new`` that it lacks; the first wins."""
    return sessions.unionByName(new.dropDuplicates(["session_id"]).join(sessions.select("session_id"), "session_id", "left_anti"), allowMissingColumns=True)


def record_session(sessions: DataFrame, session: str, repo_path: str, started_at=None) -> DataFrame:
    spark = sessions.sparkSession
    row = spark.range(1).select(F.lit(session).alias("session_id"), (F.current_timestamp() if started_at is None else F.lit(started_at)).alias("started_at"), F.lit(repo_path).alias("repo_path"))
    return record_sessions(sessions, row)


def agent_states(envelopes: DataFrame) -> DataFrame:
    acts = envelopes.where(F.col("type").isin(*ACTING) & F.col("pid").isNotNull()).select("seq", F.lit(0).alias("_k"), "ts", "session", "pid", F.lit(False).alias("_full"), F.coalesce("agent", F.lit("unknown")).alias("agent"), F.coalesce("agent", F.lit("unknown")).alias("kind"), F.lit("#888888").alias("color"), F.lit("active").alias("status"))
    rows = _rosters(envelopes).select("seq", "_k", "ts", "session", "pid", F.lit(True).alias("_full"), "agent", F.col("type").alias("kind"), "color", "status")
    every = acts.unionByName(rows).withColumn("o", F.struct("seq", "_k")).withColumn("own", F.struct("agent", "kind", "color", "session"))
    full = F.max(F.when(F.col("_full"), F.struct("o", "own")))
    return every.groupBy(F.col("pid").alias("process_id")).agg(full.alias("full"), F.min(F.struct("o", "own", "ts")).alias("first"), F.max(F.struct("o", "status", "ts")).alias("last"))


def agents_of(states: DataFrame) -> DataFrame:
    best = states.withColumn("_b", F.coalesce("full.own", "first.own"))
    return best.select("process_id", F.col("_b.agent").alias("agent_id"), F.col("_b.kind").alias("agent_type"), F.col("_b.color").alias("color"), F.col("last.status").alias("status"), F.col("_b.session").alias("session_id"), F.col("first.ts").alias("created_at"), F.col("last.ts").alias("updated_at"))


def fold_agents(envelopes: DataFrame) -> DataFrame:
    """(process_id, agent_id, agent_type, color, status, session_id, created_at, updated_at) per process.

    A roster row overwrites; any other event of a process makes it with placeholders, or marks it active.
    """
    return agents_of(agent_states(envelopes))


def version_states(envelopes: DataFrame) -> DataFrame:
    last = F.max(F.struct(F.struct("seq", "_k").alias("o"), F.coalesce("version", F.lit("1")).alias("version"), "session", "ts"))
    return _rosters(envelopes).groupBy(F.col("pid").alias("process_id")).agg(last.alias("last"))


def versions_of(states: DataFrame) -> DataFrame:
    return states.select("process_id", "last.version", F.col("last.session").alias("session_id"), F.col("last.ts").alias("introduced_at"))


def fold_protocol_versions(envelopes: DataFrame) -> DataFrame:
    """(process_id, version, session_id, introduced_at) of each process's last roster row."""
    return versions_of(version_states(envelopes))


def _patch_states(envelopes: DataFrame, what: str, field: str, update: str, value: str, parts: int) -> DataFrame:
    """(id, patch, told): the last upsert or removal of each id, and its last update; with ``parts`` the envelopes are dealt to as many tasks, and an id of many envelopes has up to 16 states, to be merged."""
    own = envelopes.where(F.col("type").isin(f"{what}.upsert", f"{what}.remove", update))
    told = F.col("type") == update
    key = F.when(told, F.col(what)).otherwise(F.col("id"))
    by = [key.alias("id")]
    if parts > 1:
        own = own.select(*by, "seq", "type", "session", "ts", field, value, F.pmod("seq", F.lit(16)).alias("deal")).repartition(parts, "id", "deal")
        by = ["id", "deal"]
    patch = F.max(F.when(~told, F.struct("seq", "type", F.col(field).alias("row"), "session", "ts")))
    return own.groupBy(*by).agg(patch.alias("patch"), F.max(F.when(told, F.struct("seq", F.col(value).alias("value"), "ts"))).alias("told")).drop("deal")


def _present(states: DataFrame, what: str) -> DataFrame:
    """The rows that were upserted last, with the update since, if any."""
    return states.where(F.col("patch.type") == f"{what}.upsert").withColumn("told", F.when(F.col("told.seq") >= F.col("patch.seq"), F.col("told")))


def node_states(envelopes: DataFrame, parts: int = 1) -> DataFrame:
    return _patch_states(envelopes, "node", "row_node", "status.update", "status", parts)


def nodes_of(states: DataFrame) -> DataFrame:
    r = F.col("patch.row")
    return _present(states, "node").select(
        "id", F.col("patch.session").alias("session_id"), r["type"].alias("type"), r["label"].alias("label"), r["parent_id"].alias("parent_id"), F.coalesce("told.value", r["status"]).alias("status"),
        r["docs"].alias("docs"), signature_json(r["signature"]).alias("signature_json"), meta_json(r["meta"]).alias("meta_json"), F.coalesce("told.ts", "patch.ts").alias("updated_at"),
    )


def fold_nodes(envelopes: DataFrame) -> DataFrame:
    """Stored nodes: last upsert or removal per id, then the last status since; test results leave the stored status alone."""
    return nodes_of(node_states(envelopes))


def edge_states(envelopes: DataFrame, parts: int = 1) -> DataFrame:
    return _patch_states(envelopes, "edge", "row_edge", "hot_edge", "hot", parts)


def edges_of(states: DataFrame) -> DataFrame:
    r = F.col("patch.row")
    return _present(states, "edge").select("id", F.col("patch.session").alias("session_id"), r["source"].alias("source"), r["target"].alias("target"), r["kind"].alias("kind"), F.coalesce("told.value", r["hot"]).alias("hot"))


def fold_edges(envelopes: DataFrame) -> DataFrame:
    """Stored edges, with the last heat since their upsert."""
    return edges_of(edge_states(envelopes))


def fold_test_results(envelopes: DataFrame) -> DataFrame:
    """One row per test; the id follows from session, node and order, so that a repeated run gives the same."""
    own = envelopes.where("type = 'test.result'")
    return own.select(F.sha2(F.concat_ws(":", "session", "node", F.col("seq").cast("string")), 256).alias("id"), F.col("pid").alias("process_id"), F.col("session").alias("session_id"), F.col("node").alias("node_id"), F.col("node").alias("test_id"), "outcome", "duration_ms", F.col("agent").alias("agent_id"), "message", "ts")


def fold_agent_activity(envelopes: DataFrame) -> DataFrame:
    own = envelopes.where("type = 'agent.activity'")
    return own.select(F.sha2(F.concat_ws(":", "session", "node", F.col("seq").cast("string"), F.lit("a")), 256).alias("id"), F.col("pid").alias("process_id"), F.col("session").alias("session_id"), F.col("agent").alias("agent_id"), "action", F.col("node").alias("node_id"), "ts")


#: Tables of one row per event, which a batch only adds to.
APPENDED = {"test_results": fold_test_results, "agent_activity": fold_agent_activity}


class Keyed(NamedTuple):
    """A table folded by key: its states carry the order of each value, so that two states of a key merge by least and greatest, column by column."""

    key: str
    states: Callable[..., DataFrame]
    rows: Callable[[DataFrame], DataFrame]
    least: tuple[str, ...] = ()  # columns of which the least stays; of the others the greatest
    wide: bool = False  # states are whole rows, made in a given number of tasks

    def merged(self, states: DataFrame, dealt: tuple[str, ...] = ()) -> DataFrame:
        """One state a key; ``dealt``: columns that follow from the key, by which the states are dealt already."""
        return states.groupBy(*dealt, self.key).agg(*[(F.min if c in self.least else F.max)(c).alias(c) for c in states.columns if c not in (self.key, *dealt)])


KEYED = {
    "sessions": Keyed("session_id", session_states, sessions_of, ("first",)), "agents": Keyed("process_id", agent_states, agents_of, ("first",)), "protocol_versions": Keyed("process_id", version_states, versions_of),
    "nodes": Keyed("id", node_states, nodes_of, wide=True), "edges": Keyed("id", edge_states, edges_of, wide=True),
}

#: Envelopes or states that one task folds, about; a bucket of more is dealt among several tasks and is as many files.
TASK_STATES = 250_000

_MANIFEST = "number long, batch long, table string, buckets int, bucket int, n long, path string, schema string"


def _manifest(spark: SparkSession, base_path: str) -> list:
    """Rows of the newest manifest: of each keyed table its schema and the folder and size of each bucket. Few rows, since only the last two manifests are kept."""
    try:
        every = spark.read.schema(_MANIFEST).json(f"{base_path}/_manifests/*")
        last = every.agg(F.max("number").alias("number"))
        return every.join(last, "number", "left_semi").collect()
    except Exception as e:  # no commit yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []


def _bucketed(states: DataFrame, key: str, buckets: int) -> DataFrame:
    return states.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets).cast("long")).cast("int"))


def _merge_into(spark: SparkSession, held: list, name: str, states: DataFrame, path: str, buckets: int, most: int) -> list[tuple]:
    """Merges a batch's ``states`` into the buckets that they touch, which are written anew at ``path``; (table, buckets, bucket, n, path, schema) of the table's buckets afterwards.

    Buckets double once a batch at most, so a large batch fills them beyond ``most``; tasks follow the number of states and not that of buckets.
    """
    table = KEYED[name]
    old = [r for r in held if r["table"] == name and r["bucket"] >= 0]
    buckets = next((r["buckets"] for r in held if r["table"] == name), buckets)
    split = sum(r["n"] for r in old) > most * buckets
    if split:
        buckets *= 2
    own = cut(_bucketed(states, table.key, buckets))
    counts = {r["bucket"]: r["count"] for r in own.groupBy("bucket").count().collect()}  # a row per bucket
    touched = [r for r in old if split or r["bucket"] in counts]
    schema = own.drop("bucket").schema
    if touched:
        before = _bucketed(spark.read.schema(schema).parquet(*[r["path"] for r in touched]), table.key, buckets)
        own = before.unionByName(own)
    rows = []
    if counts or touched:
        n, met = sum(counts.values()) + sum(r["n"] for r in touched), min(buckets, max(len(counts), len(touched)))
        parts = max(met, n // TASK_STATES + 1)
        # A bucket is one task's and one file while it is small. Beyond that it goes by slices, some to a task, so that tasks are of one size.
        slices = 1 if parts == met else 8 * parts // met
        dealt = own.withColumn("slice", F.pmod(F.xxhash64(table.key, F.lit(1)), F.lit(slices).cast("long"))).repartition(parts, "bucket", "slice")
        table.merged(dealt, ("bucket", "slice")).drop("slice").write.mode("overwrite").partitionBy("bucket").parquet(path)
        sizes = spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(path).groupBy("bucket").count().collect()
        rows = [(name, buckets, r["bucket"], r["count"], f"{path}/bucket={r['bucket']}", None) for r in sizes]
    gone = {r["path"] for r in touched}
    rows += [(name, buckets, r["bucket"], r["n"], r["path"], None) for r in old if r["path"] not in gone]
    return [(name, buckets, -1, 0, None, schema.json()), *rows]


def persist_events(envelopes: DataFrame, base_path: str, batch: int, buckets: int = 16, most: int = 200_000) -> None:
    """Adds batch number ``batch`` of envelopes to the history and to the seven tables; batches come in the order of their numbers, and a repeated one changes nothing.

    The history and the tables of one row per event are written under the batch's own folder and seen up to the batch that the newest manifest names. Of the keyed tables only the
    buckets of keys that the batch touches are read, merged and written, so its cost follows the batch and not the history; when buckets hold more than ``most`` keys on average
    their number doubles. The manifest is written last and makes all of it current at once; what neither it nor the one before it names is removed.
    """
    spark = envelopes.sparkSession
    structured_only(envelopes).write.mode("overwrite").parquet(f"{base_path}/history/batch={int(batch)}")
    own = spark.read.schema(structured_only(envelopes).schema).parquet(f"{base_path}/history/batch={int(batch)}")
    for name, fold in APPENDED.items():
        fold(own).write.mode("overwrite").parquet(f"{base_path}/{name}/batch={int(batch)}")
    held = _manifest(spark, base_path)
    number, last = (held[0]["number"] + 1, held[0]["batch"]) if held else (0, -1)
    version = f"v-{number:012d}-{uuid.uuid4().hex}"
    parts = own.where(F.col("type").isin(*PATCHES)).count() // TASK_STATES + 1
    states = lambda table: table.states(own, parts) if table.wide else table.states(own)
    one = lambda name: _merge_into(spark, held, name, states(KEYED[name]), f"{base_path}/{name}/{version}", buckets, most)
    with ThreadPoolExecutor(len(KEYED)) as pool:  # the tables' jobs run side by side
        rows = [r for part in pool.map(one, KEYED) for r in part]
    made = [(number, max(int(batch), last), *r) for r in rows]
    spark.createDataFrame(made, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{base_path}/_manifests/{number:012d}")
    _forget(spark, base_path, number)


def _forget(spark: SparkSession, base_path: str, number: int) -> None:
    """Removes the manifest before the last two, and the version folders that only it named."""
    old = number - 2
    if old < 0:
        return
    try:
        before = spark.read.schema(_MANIFEST).json(f"{base_path}/_manifests/{old:012d}").where("path is not null").select("path").collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return
    kept = spark.read.schema(_MANIFEST).json([f"{base_path}/_manifests/{k:012d}" for k in (number - 1, number)]).where("path is not null").select("path").collect()
    kept = {r["path"] for r in kept}
    for path in {r["path"] for r in before} - kept:
        remove(spark, path)
        folder = path.rsplit("/", 1)[0]
        if not any(k.startswith(f"{folder}/") for k in kept):
            remove(spark, folder)
    remove(spark, f"{base_path}/_manifests/{old:012d}")


def persist_stream(envelopes: DataFrame, base_path: str, checkpoint: str):
    """The same, batch by batch, of a stream."""
    return envelopes.writeStream.foreachBatch(lambda df, k: persist_events(df, base_path, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, base_path: str) -> int | None:
    """Number of the last batch that is part of the tables; None before the first commit."""
    held = _manifest(spark, base_path)
    return held[0]["batch"] if held else None


def load_table(spark: SparkSession, base_path: str, name: str) -> DataFrame | None:
    """The current rows of a table; None before the first commit."""
    held = _manifest(spark, base_path)
    if not held:
        return None
    if name in APPENDED:
        return spark.read.parquet(f"{base_path}/{name}").where(F.col("batch") <= held[0]["batch"]).drop("batch")
    schema = next(StructType.fromJson(json.loads(r["schema"])) for r in held if r["table"] == name and r["bucket"] < 0)
    paths = [r["path"] for r in held if r["table"] == name and r["path"]]
    return KEYED[name].rows(spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema))


def load_graph(spark: SparkSession, base_path: str, session: str) -> tuple[DataFrame, DataFrame]:
    """Stored nodes and edges of a session; corrupt JSON is an error, an unknown session is empty, child_ids are left to be derived."""
    nodes, edges = load_table(spark, base_path, "nodes"), load_table(spark, base_path, "edges")
    own = nodes.where(F.col("session_id") == session)
    decoded = own.select("id", "type", "label", "parent_id", F.array().cast("array<string>").alias("child_ids"), "status", "docs", signature_from_json("signature_json").alias("signature"), meta_from_json("meta_json").alias("meta"))
    return decoded, edges.where(F.col("session_id") == session).select("id", "source", "target", "kind", "hot")
