"""Counts, latencies, rosters and windowed rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_parse_latency(samples: DataFrame) -> DataFrame:
    """(file, duration) of the last sample of each file."""
    return samples.groupBy("file").agg(F.max_by("duration", "seq").alias("duration"))


def slowest_files(latency: DataFrame, k: int = 10) -> DataFrame:
    return latency.orderBy(F.desc("duration"), "file").limit(k)


def roster_by_agent(roster: DataFrame) -> DataFrame:
    """(agent, active, color): active if any process is; colour of the first-seen row."""
    return roster.groupBy("agent").agg(F.bool_or(F.col("status") == "active").alias("active"), F.min_by("color", "first_seq").alias("color"))


def roster_snapshot(roster: DataFrame) -> DataFrame:
    """All rows in order of the process; no row when there is none."""
    return roster.orderBy("pid")


def roster_envelope(roster: DataFrame) -> DataFrame:
    """One row with the roster as an array, for those who ask for a message; nothing for an empty roster."""
    return roster.agg(F.sort_array(F.collect_list(F.struct("pid", "agent", "color", "status"))).alias("agents")).where("size(agents) > 0")


def authored_count(edges: DataFrame) -> DataFrame:
    """(agent_node, nodes): distinct nodes that each agent touched."""
    return edges.where("kind = 'authored_by'").groupBy(F.col("target").alias("agent_node")).agg(F.countDistinct("source").alias("nodes"))


def event_counts(envelopes: DataFrame, interval_ms: int = 2000) -> DataFrame:
    """(window_ms, n): envelopes other than metrics per tumbling window."""
    step = max(interval_ms, 1)
    return envelopes.where("type <> 'metrics.update'").groupBy((F.floor(F.col("ts_ms") / step) * step).alias("window_ms")).agg(F.count("*").alias("n"))


def metrics_windows(envelopes: DataFrame, interval_ms: int = 2000) -> DataFrame:
    """(window_ms, n, events_per_sec_milli) for every window from the first to the last, quiet ones with 0."""
    step = max(interval_ms, 1)
    counts = event_counts(envelopes, step)
    every = counts.agg(F.min("window_ms").alias("a"), F.max("window_ms").alias("b")).where("a is not null").select(F.explode(F.expr(f"sequence(a, b, {step}L)")).alias("window_ms"))
    rate = F.expr(f"(n * 1000000) div {step}")
    return every.join(counts, "window_ms", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("events_per_sec_milli", rate)


def metrics_snapshots(windows: DataFrame, counts: DataFrame, latency: DataFrame) -> DataFrame:
    """Windows with the graph's counts and the slowest files' latency, as the metrics message carries them."""
    listed = slowest_files(latency).agg(F.sort_array(F.collect_list(F.struct("file", "duration"))).alias("parse_latency"))
    return windows.join(counts).join(listed)
