"""Graph and event tables derived from the driver's tables.

Each is a query in the SQL that Spark and DuckDB share; where they differ, a mark in @ is written out per engine. So the operators and
the SQL they are checked against start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

VIEWS = {
    "places": "SELECT c_custkey, n_nationkey, 'r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING) || '/c' || CAST(c_custkey AS STRING) AS path FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "fns": "SELECT o_orderkey, o_custkey, path, 'o' || CAST(o_orderkey AS STRING) AS name, 'fn:' || path || ':o' || CAST(o_orderkey AS STRING) AS id, o_orderkey AS k FROM orders JOIN places ON o_custkey = c_custkey",
    "vars": """SELECT f.path, f.name AS fn, 'l' || CAST(l_linenumber AS STRING) AS var, 'var:' || f.path || ':' || f.name || ':l' || CAST(l_linenumber AS STRING) AS id, f.id AS parent_id, 'p' || CAST(max(l_partkey) AS STRING) AS label
               FROM lineitem JOIN fns f ON l_orderkey = f.o_orderkey GROUP BY f.path, f.name, f.id, l_linenumber""",
    "graph_nodes": """SELECT 'svc:r' || CAST(r_regionkey AS STRING) AS id, 'service' AS type, r_name AS label, CAST(NULL AS STRING) AS parent_id FROM region
        UNION ALL SELECT 'mod:r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING), 'module', n_name, 'svc:r' || CAST(n_regionkey AS STRING) FROM nation
        UNION ALL SELECT 'file:' || path, 'file', 'c' || CAST(c_custkey AS STRING), 'mod:' || regexp_replace(path, '/c[0-9]+$', '') FROM places
        UNION ALL SELECT id, 'function', name, 'file:' || path FROM fns
        UNION ALL SELECT id, 'variable', label, parent_id FROM vars""",
    "next_order": "SELECT o.o_orderkey, lead(o.o_orderkey) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS next_key FROM orders o",
    "call_pairs": "SELECT a.id AS source, b.id AS target, a.o_orderkey AS s_key, b.o_orderkey AS t_key FROM next_order n JOIN fns a ON n.o_orderkey = a.o_orderkey JOIN fns b ON n.next_key = b.o_orderkey",
    "flow_pairs": "SELECT DISTINCT p.source, p.target FROM call_pairs p JOIN lineitem x ON x.l_orderkey = p.s_key JOIN lineitem y ON y.l_orderkey = p.t_key AND x.l_partkey = y.l_partkey",
    "authorships": "SELECT DISTINCT f.id AS source, 'agent:supplier-' || CAST(l_suppkey % 20 AS STRING) AS target FROM lineitem JOIN fns f ON l_orderkey = f.o_orderkey",
    "graph_edges": """SELECT 'e:' || parent_id || '->' || id AS id, parent_id AS source, id AS target, 'contains' AS kind, false AS hot FROM graph_nodes WHERE parent_id IS NOT NULL
        UNION ALL SELECT 'e:' || source || '->' || target || ':calls', source, target, 'calls', false FROM call_pairs
        UNION ALL SELECT 'e:' || source || '->' || target || ':data_flows_from', source, target, 'data_flows_from', false FROM flow_pairs
        UNION ALL SELECT 'e:' || target || '->' || source || ':param_source', target, source, 'param_source', false FROM flow_pairs
        UNION ALL SELECT 'e:' || source || '->' || target || ':authored_by', source, target, 'authored_by', false FROM authorships""",
    "call_edges": "SELECT 'e:' || source || '->' || target || ':calls' AS id, s_key AS k FROM call_pairs",
    "numbered": "SELECT event_id, user_id, event_type, ts, @ms(ts)@ AS ts_ms, event_id % (SELECT count(*) FROM orders) AS fn_k, (event_id @div@ 4) % (SELECT count(*) FROM orders) AS edge_k FROM events",
    "clv_events": """SELECT e.event_id AS seq, e.ts, e.ts_ms, '@@' || @day(e.ts)@ AS session, e.user_id AS pid,
            CASE WHEN e.user_id % 50 = 0 THEN 'a:' || CAST(e.user_id AS STRING) || '%' ELSE 'agent-' || CAST(e.user_id % 7 AS STRING) END AS agent,
            CASE e.event_type WHEN 'click' THEN 'hotedge' WHEN 'view' THEN 'hotedge' WHEN 'error' THEN 'test' WHEN 'purchase' THEN 'test' ELSE 'activity' END AS event,
            CASE WHEN e.event_type IN ('click', 'view') THEN NULL WHEN e.event_id % 13 = 0 THEN 'fn:none:' || CAST(e.event_id AS STRING) ELSE f.id END AS node,
            CASE WHEN e.event_type = 'signup' THEN 'modified' END AS action, CASE e.event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'pass' END AS outcome,
            CASE WHEN e.event_type IN ('click', 'view') THEN c.id END AS edge, CASE e.event_type WHEN 'click' THEN 'enter' WHEN 'view' THEN 'exit' END AS state
        FROM numbered e LEFT JOIN fns f ON e.fn_k = f.k LEFT JOIN call_edges c ON e.edge_k = c.k""",
    "tagged": """SELECT seq, CASE seq % 17 WHEN 1 THEN '#CLV1' ELSE '#CLV1 ' END || CASE WHEN seq % 17 = 0 THEN '{broken' ELSE '{"event":"' || event || '"' || CASE WHEN seq % 17 = 2 THEN '' ELSE ',"session":"' || session || '"' END
            || ',"pid":' || CAST(pid AS STRING) || ',"agent":"' || agent || '"' || coalesce(',"node":"' || node || '"', '') || coalesce(',"action":"' || action || '"', '') || coalesce(',"outcome":"' || outcome || '"', '')
            || coalesce(',"edge":"' || edge || '"', '') || coalesce(',"state":"' || state || '"', '') || '}' || CASE WHEN seq % 17 = 3 THEN ' tail' ELSE '' END END AS value FROM clv_events""",
    "envelope_lines": """SELECT seq, '{"v":1,"ts":"' || session || 'T00:00:00Z","sessionId":"' || session || '","type":"' || CASE event WHEN 'test' THEN 'test.result' WHEN 'hotedge' THEN 'hot_edge' ELSE 'agent.activity' END || '","payload":'
            || CASE WHEN seq % 19 = 0 THEN '{"nodeId":7}' WHEN event = 'test' THEN '{"nodeId":"' || node || '","testId":"' || node || '","outcome":"' || outcome || '"}'
                    WHEN event = 'hotedge' THEN '{"edgeId":"' || edge || '","state":"' || state || '"}' ELSE '{"agentId":"' || agent || '","action":"' || action || '","nodeId":"' || node || '"}' END || '}' AS value FROM clv_events""",
    "flat_envelopes": "SELECT seq, ts, ts_ms, CASE event WHEN 'test' THEN 'test.result' WHEN 'hotedge' THEN 'hot_edge' ELSE 'agent.activity' END AS type, session, pid, agent, node, edge, CAST(NULL AS STRING) AS status, outcome, CAST(NULL AS BIGINT) AS duration_ms, CAST(NULL AS STRING) AS message, action, state = 'enter' AS hot, CAST(NULL AS STRING) AS id FROM clv_events",
    "new_nodes": """SELECT id, type, CASE WHEN type = 'function' AND k2 = 2 THEN label || '-new' ELSE label END AS label, parent_id, owner FROM (
            SELECT n.id, n.type, n.label, n.parent_id, 'file:' || p.path AS owner, -1 AS k2, p.c_custkey FROM graph_nodes n JOIN places p ON n.id = 'file:' || p.path
            UNION ALL SELECT f.id, 'function', f.name, 'file:' || f.path, 'file:' || f.path, f.o_orderkey % 10, f.o_custkey FROM fns f) t WHERE c_custkey % 3 = 0 AND k2 <> 1""",
    "old_nodes": "SELECT n.id, n.type, n.label, n.parent_id, CASE WHEN n.type = 'file' THEN n.id ELSE n.parent_id END AS owner FROM graph_nodes n WHERE n.type IN ('file', 'function')",
    "old_edges": "SELECT e.id, e.source, e.target, e.kind, e.hot, e.source AS owner FROM graph_edges e WHERE e.kind = 'contains' AND e.source LIKE 'file:%'",
    "new_edges": "SELECT e.id, e.source, e.target, e.kind, e.hot, e.owner FROM old_edges e JOIN new_nodes n ON e.target = n.id",
    "change_times": "SELECT 'root' || CAST(user_id % 50 AS STRING) AS root, 'c' || CAST(user_id AS STRING) AS path, CAST((@ms(ts)@ - (SELECT min(@ms(ts)@) FROM events)) * (SELECT count(*) FROM events) * 6 @div@ 2592000000 AS BIGINT) AS ts_ms FROM events",
    "hot_dense": "SELECT seq, seq AS ts_ms, 'e' || CAST(seq % 5 AS STRING) || ':' || CAST(seq @div@ 5000 AS STRING) AS edge, state FROM clv_events WHERE event = 'hotedge'",
    "parse_samples": "SELECT 'part/' || CAST(l_partkey AS STRING) AS file, CAST(max(floor(l_extendedprice)) AS BIGINT) AS duration, CAST(l_orderkey AS BIGINT) * 100 + l_linenumber AS seq FROM lineitem GROUP BY 1, 3",
    "fact_functions": "SELECT path, name FROM fns WHERE o_orderkey % 2 = 0",
    "call_args": """SELECT DISTINCT f.path, f.name AS caller, CAST(l_suppkey * 20 AS BIGINT) AS pos, 'o' || CAST(f.o_orderkey + (l_linenumber % 2) AS STRING) AS callee, l_linenumber % 4 = 3 AS qualified,
            CASE l_linenumber % 3 WHEN 0 THEN 'call' WHEN 1 THEN 'name' ELSE 'other' END AS arg_kind,
            CASE l_linenumber % 3 WHEN 0 THEN 'o' || CAST(n.next_key AS STRING) WHEN 1 THEN 'v' || CAST(l_linenumber % 2 AS STRING) END AS arg_name
        FROM lineitem JOIN fns f ON l_orderkey = f.o_orderkey JOIN next_order n ON n.o_orderkey = f.o_orderkey""",
    "bindings": """SELECT path, fn, pos, var, max(init_callee) AS init_callee FROM (SELECT f.path, f.name AS fn, CAST(l_partkey AS BIGINT) AS pos, 'v' || CAST(l_linenumber % 2 AS STRING) AS var, CASE WHEN l_linenumber % 5 <> 4 THEN 'o' || CAST(n.next_key AS STRING) END AS init_callee
        FROM lineitem JOIN fns f ON l_orderkey = f.o_orderkey JOIN next_order n ON n.o_orderkey = f.o_orderkey) t GROUP BY path, fn, pos, var""",
    "source_rows": """SELECT path || '.rs' AS path, o_orderkey, '/// order of ' || path || chr(10) || 'fn o' || CAST(o_orderkey AS STRING) || '(a: i32) -> i32 {' || chr(10) || '    let l1 = o' || CAST(o_orderkey + 1 AS STRING) || '(a);' || chr(10) || '    l1' || chr(10) || '}' AS part FROM fns""",
    "module_rows": """SELECT path || CASE o_custkey % 3 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' ELSE '.ts' END AS path, o_custkey % 3 AS tongue, o_orderkey, CASE o_custkey % 3
            WHEN 0 THEN 'fn o' || CAST(o_orderkey AS STRING) || '(' || chr(10) || '    a: i32, // (' || chr(10) || '    b: u8,' || chr(10) || ') -> i32' || chr(10) || '{' || chr(10) || '    "(((' || chr(10) || '  fn no(" /* [[' || chr(10) || ' {{ */' || chr(10) || '}'
            WHEN 1 THEN 'def o' || CAST(o_orderkey AS STRING) || '(' || chr(10) || '    a: int,  # [' || chr(10) || '    b: str,' || chr(10) || ') -> int:' || chr(10) || '    return "{"'
            ELSE 'function o' || CAST(o_orderkey AS STRING) || '(' || chr(10) || '  a: number,' || chr(10) || '  b: string,' || chr(10) || '): number {' || chr(10) || '  return `((' || chr(10) || '[`;' || chr(10) || '}' END
            || CASE WHEN o_orderkey % 31 = 0 THEN chr(10) || '(' ELSE '' END AS part FROM fns""",
}
#: What differs between the engines. DuckDB's epoch_ms rounds microseconds, halves away from zero; unix_millis cuts them off.
_SPARK = {"once": "", "div": "div", "ms": r"((unix_micros(CAST(\1 AS TIMESTAMP)) + if(unix_micros(CAST(\1 AS TIMESTAMP)) < 0, -500, 500)) div 1000)", "day": r"date_format(\1, 'yyyy-MM-dd')"}
_DUCK = {"once": "MATERIALIZED ", "div": "//", "ms": r"epoch_ms(\1)", "day": r"strftime(\1, '%Y-%m-%d')"}


def _written(sql: str, marks: dict[str, str]) -> str:
    for name in ("ms", "day"):
        sql = re.sub(rf"@{name}\(([^()]*)\)@", marks[name], sql)
    return sql.replace("@div@", marks["div"]).replace("'@@' || ", "")


def _needed(sql: str) -> list[str]:
    """The views that a query uses, each after those that it uses itself."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name, own in VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in out:
                visit(own)
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def with_views(sql: str, marks: dict[str, str] = _DUCK) -> str:
    """The query with the views it uses before it; a leading WITH [RECURSIVE] of its own is continued."""
    own = re.match(r"\s*WITH( RECURSIVE)?\s", sql)
    views = ", ".join(f"{n} AS {marks['once']}({VIEWS[n]})" for n in _needed(sql))
    if not views:
        return _written(sql, marks)
    rest = sql[own.end() :] if own else None
    return _written(f"WITH{own[1] or '' if own else ''} {views}" + (f", {rest}" if own else f" {sql}"), marks)


def duck(sql: str) -> str:
    return with_views(sql, _DUCK)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables of a data folder."""
    sql = with_views(f"SELECT * FROM {name}", _SPARK)
    for table in BASE:
        sql = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 parquet.`{sf_dir}/{table}.parquet` AS {table}", sql)
    return spark.sql(re.sub(r"AS (orders|lineitem) ([a-z])\b(?! JOIN)", r"AS \2", sql))
