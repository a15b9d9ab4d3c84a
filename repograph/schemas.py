"""Row types and closed vocabularies."""

from __future__ import annotations

#: Node type -> id prefix.
NODE_PREFIX = {"service": "svc", "module": "mod", "file": "file", "function": "fn", "variable": "var", "test": "test", "agent": "agent"}
#: Closed word lists.
STATUSES = ("unknown", "passing", "failing", "running", "stale", "error")
OUTCOMES = ("pass", "fail", "skip", "running")
EDGE_KINDS = ("calls", "imports", "contains", "tested_by", "authored_by", "param_source", "data_flows_from")
INPUT_EVENTS = ("activity", "test", "status", "hotedge")
ENVELOPE_TYPES = (
    "node.upsert", "node.remove", "edge.upsert", "edge.remove", "status.update", "test.result", "agent.activity", "hot_edge", "agent.roster", "snapshot", "subtree", "metrics.update",
)
#: Outcome of a test -> status of its node.
STATUS_OF_OUTCOME = {"pass": "passing", "fail": "failing", "skip": "stale", "running": "running"}
#: Kind of an edge -> class of flow.
FLOW_OF_KIND = {"calls": "control", "param_source": "data", "data_flows_from": "data", "authored_by": "agent"}
#: Extension -> language.
LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript"}

SIGNATURE = "struct<params: array<struct<name: string, type: string>>, returns: string>"
META = "struct<language: string, filePath: string, range: struct<startLine: int, startCol: int, endLine: int, endCol: int>>"
NODE = f"id string, type string, label string, parent_id string, child_ids array<string>, status string, docs string, signature {SIGNATURE}, meta {META}"
EDGE = "id string, source string, target string, kind string, hot boolean"
NODE_FIELDS = tuple(part.strip().split(" ")[0] for part in ("id", "type", "label", "parent_id", "child_ids", "status", "docs", "signature", "meta"))
EDGE_FIELDS = ("id", "source", "target", "kind", "hot")
#: The decoded tagged line.
EVENT = "event string, session string, pid long, agent string, node string, action string, outcome string, durationMs decimal(20,0), msg string, edge string, state string"
MOST_PID = 4294967295
MOST_LONG = 9223372036854775807
