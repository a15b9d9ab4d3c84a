"""Graph tables: filters, hierarchy, visibility and authorship.

Ids that are asked for come as a table too; joins are left to Catalyst, which broadcasts a side only under its size limit.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import agent_node_id, bare_agent_id, docs_or_placeholder, estimate_memory, flow_class


def root_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id is null")


def filter_flow(edges: DataFrame, control: bool = True, data: bool = True, agent: bool = False) -> DataFrame:
    """Edges of the flow classes that are shown; an edge without a class never is."""
    shown = [name for name, on in (("control", control), ("data", data), ("agent", agent)) if on]
    return edges.where(flow_class("kind").isin(shown)) if shown else edges.where(F.lit(False))


def agent_layer(nodes: DataFrame, show: bool) -> DataFrame:
    return nodes if show else nodes.where("type <> 'agent'")


def for_session(df: DataFrame, session: str) -> DataFrame:
    return df.where(F.col("session_id") == session)


def non_overlay(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the agents and what they authored, which belong to no file."""
    return nodes.where("type <> 'agent'"), edges.where("kind <> 'authored_by'")


def _between(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids`` (column id)."""
    one = ids.select(F.col("id").alias("_end")).distinct()
    return edges.join(one, F.col("source") == F.col("_end"), "left_semi").join(one, F.col("target") == F.col("_end"), "left_semi")


def snapshot(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots, and the edges among them."""
    roots = stored(root_nodes(nodes))  # so Catalyst knows their size, and joins few roots where edges are made
    return roots, _between(edges, roots)


def subtree_all(nodes: DataFrame, edges: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Direct children of each id in ``parents``, and the containing edges to them."""
    asked = parents.select(F.col("id").alias("_p")).distinct()
    children = nodes.join(asked, F.col("parent_id") == F.col("_p"), "left_semi")
    pairs = children.select(F.col("parent_id").alias("_p"), F.col("id").alias("_c"))
    kept = edges.where("kind = 'contains'").join(pairs, (F.col("source") == F.col("_p")) & (F.col("target") == F.col("_c")), "left_semi")
    return children, kept


def children_of(nodes: DataFrame, edges: DataFrame, parent: str) -> tuple[DataFrame, DataFrame]:
    """One tier below one node: the filters reach the scan."""
    children = nodes.where(F.col("parent_id") == parent)
    own = edges.where((F.col("kind") == "contains") & (F.col("source") == parent))
    return children, own.join(children.select(F.col("id").alias("_c")), F.col("target") == F.col("_c"), "left_semi")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset a temporary one, but only on a master in one JVM."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut; for what is read more than once."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller than a checkpoint, read by column and of a size that Catalyst knows."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _climbed(nodes: DataFrame, max_depth: int, marked: DataFrame | None = None, kept: bool = False) -> DataFrame:
    """(id, path, beyond, under): ids from the topmost present ancestor down to the node, the absent parent named above it, if any, and those ancestors that are ``marked`` (column id).

    While at least half of the nodes are no parent of others, these are set aside; in the end each takes the path of its parent, in one join. So a wide tree is done tier by tier, and no node is joined to
    the few at its top. What is left, deep tiers and cycles, is done by doubling. ``kept``: the nodes are written already, and aren't written again.
    """
    rest = nodes.select("id", "parent_id", F.lit(False).alias("mark"))
    if marked is not None:
        own = marked.select(F.col("id").alias("_m")).distinct()
        rest = nodes.select("id", "parent_id").join(own, F.col("id") == F.col("_m"), "left").select("id", "parent_id", F.col("_m").isNotNull().alias("mark"))
    rest, tiers = rest if kept and marked is None else stored(rest), []
    n = rest.count()
    while n:
        named = _parents(rest)
        split = stored(rest.join(named, F.col("id") == F.col("_p"), "left").select("id", "parent_id", "mark", F.col("_p").isNotNull().alias("inner")))
        left = split.where("inner").count()
        if 2 * left > n:
            break
        tiers.append(split.where("not inner"))
        rest, n = split.where("inner").drop("inner"), left
    done = _doubled(rest, max_depth) if n else None
    for tier in reversed(tiers):
        own = lambda path, beyond, under: tier.select("id", "mark", path.alias("path"), beyond.alias("beyond"), under.alias("under"))  # noqa: B023, E731
        if done is None:
            done = own(F.array("id"), F.col("parent_id"), F.array().cast("array<string>"))
            continue
        above = done.select(F.col("id").alias("_id"), F.col("path").alias("_path"), F.col("beyond").alias("_beyond"), F.when(F.col("mark"), F.concat("under", F.array("id"))).otherwise(F.col("under")).alias("_under"))
        absent = F.col("_id").isNull()
        tier = tier.join(above, F.col("parent_id") == F.col("_id"), "left")
        path = F.when(absent, F.array("id")).otherwise(F.concat("_path", F.array("id")))
        made = stored(own(path, F.when(absent, F.col("parent_id")).otherwise(F.col("_beyond")), F.coalesce("_under", F.array().cast("array<string>"))))
        _checked(made, max_depth)
        done = done.unionByName(made)
    if done is None:
        done = rest.select("id", "mark", F.array("id").alias("path"), F.col("parent_id").alias("beyond"), F.array().cast("array<string>").alias("under"))
    return done.select("id", "path", "beyond", "under")


def _checked(made: DataFrame, max_depth: int) -> None:
    if not made.where(F.size("path") > max_depth + 1).isEmpty():
        raise RuntimeError(f"nodes have more than {max_depth} tiers above them")


def _doubled(nodes: DataFrame, max_depth: int) -> DataFrame:
    """(id, mark, path, beyond, under) of ``nodes`` (id, parent_id, mark) by doubling: each round puts the path of the node that a path ends under on top of it, so paths of a tier of 1,000 are whole after ten joins.

    A cycle ends where it closes: of the path put on top only what lies below the first node met again is kept. Each round is stored, and what is whole isn't written again.
    """
    nodes = nodes.select("id", "mark", F.col("parent_id").alias("next"), F.array("id").alias("path"), F.lit(None).cast("string").alias("beyond"), F.array().cast("array<string>").alias("under"))
    whole, now = [nodes.where("next is null")], nodes.where("next is not null")
    while not now.isEmpty():
        every = reduce(DataFrame.unionByName, [*whole, now])
        listed = F.when(F.col("mark"), F.concat("under", F.array("id"))).otherwise(F.col("under"))
        above = every.select(F.col("id").alias("_id"), F.col("next").alias("_next"), F.col("path").alias("_path"), F.col("beyond").alias("_beyond"), listed.alias("_under"))
        met = now.join(above, F.col("next") == F.col("_id"), "left")
        again = F.arrays_overlap("_path", "path")
        last = F.expr("array_max(transform(sequence(1, size(_path)), i -> if(array_contains(path, element_at(_path, i)), i, 0)))")
        kept = F.slice("_path", last + 1, F.size("_path"))
        absent = F.col("_id").isNull()
        path = F.when(absent, F.col("path")).when(again, F.concat(kept, F.col("path"))).otherwise(F.concat("_path", "path"))
        under = F.when(absent, F.col("under")).when(again, F.concat(F.array_intersect(kept, F.col("_under")), F.col("under"))).otherwise(F.concat("_under", "under"))
        beyond = F.when(absent, F.col("next")).when(~again, F.col("_beyond"))
        made = stored(met.select("id", "mark", F.when(~absent & ~again, F.col("_next")).alias("next"), path.alias("path"), beyond.alias("beyond"), under.alias("under")))
        _checked(made, max_depth)
        whole.append(made.where("next is null"))
        now = made.where("next is not null")
    return reduce(DataFrame.unionByName, whole).drop("next")


def ancestor_paths(nodes: DataFrame, max_depth: int = 100_000, kept: bool = False) -> DataFrame:
    """(id, path): ids from the topmost present ancestor down to the node, in as many joins as the logarithm of the depth; nodes more than ``max_depth`` tiers down are an error."""
    return _climbed(nodes, max_depth, kept=kept).select("id", "path")


def owning_file(nodes: DataFrame, max_depth: int = 100_000, kept: bool = False) -> DataFrame:
    """(id, owner): the topmost present ancestor of each node."""
    return ancestor_paths(nodes, max_depth, kept).select("id", F.element_at("path", 1).alias("owner"))


def _below(nodes: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(root, id) of everything below each root, as often as the rows have it; marks travel down the tree with the paths, so there is no join by root but for parents that are only named."""
    climbed = _climbed(nodes, max_depth, roots)
    absent = climbed.where("beyond is not null").select(F.col("beyond").alias("root"), "id").join(roots.select(F.col("id").alias("root")).distinct(), "root", "left_semi")
    return climbed.select(F.explode("under").alias("root"), "id").unionByName(absent)


def descendants(nodes: DataFrame, roots: DataFrame, max_depth: int = 100_000) -> DataFrame:
    """(root, id): everything below each id of ``roots``, without the root itself, each node once per root; a root may be absent from the nodes, as a parent that is only named."""
    return _below(nodes, roots, max_depth).distinct()


def _parents(nodes: DataFrame) -> DataFrame:
    """(_p) ids that are named as a parent."""
    return nodes.where("parent_id is not null").select(F.col("parent_id").alias("_p")).distinct()


def _gone(nodes: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(_gone) ids of all nodes below one of the roots. Only nodes that are parents are walked; each node then asks its parent for the roots at and above it."""
    asked = roots.select(F.col("id").alias("_r")).distinct()
    inner = nodes.join(_parents(nodes), F.col("id") == F.col("_p"), "left_semi").select("id", "parent_id")
    walked = _climbed(inner, max_depth, roots).select("id", "beyond", "under")
    own, above = F.array("id"), F.array("beyond")
    met = walked.join(asked, F.col("id") == F.col("_r"), "left").withColumnRenamed("_r", "_own").join(asked, F.col("beyond") == F.col("_r"), "left")
    none = F.array().cast("array<string>")
    shut = met.select(F.col("id").alias("_shut"), F.concat("under", F.when(F.col("_own").isNotNull(), own).otherwise(none), F.when(F.col("_r").isNotNull(), above).otherwise(none)).alias("_roots")).where(F.size("_roots") > 0)
    absent = asked.join(inner, F.col("_r") == F.col("id"), "left_anti").select(F.col("_r").alias("_shut"), F.array("_r").alias("_roots"))
    below = nodes.select("id", "parent_id").join(shut.unionByName(absent), F.col("parent_id") == F.col("_shut"))
    return below.where(F.size(F.array_remove("_roots", F.col("id"))) > 0).select(F.col("id").alias("_gone")).distinct()


def collapse(nodes: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Without what lies below the roots, and without edges that touch it."""
    gone = stored(_gone(nodes, roots, max_depth))
    # Outer joins: Catalyst would push anti joins below the unions and joins that edges come from, and do them once per branch.
    out = lambda df, end: df.join(gone, F.col(end) == F.col("_gone"), "left").where("_gone is null").drop("_gone")
    return out(nodes, "id"), out(out(edges, "source"), "target")


def visible_edges(edges: DataFrame, visible: DataFrame, control: bool = True, data: bool = True, agent: bool = False) -> DataFrame:
    """Shown edges with both ends visible."""
    return _between(filter_flow(edges, control, data, agent), visible).select("id", "source", "target", "kind", flow_class("kind").alias("flow"), "hot")


def nodes_authored_by(edges: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent, node): what each of the ``agents`` (column agent) touched."""
    ends = agents.select("agent", agent_node_id("agent").alias("_end")).distinct()
    return edges.where("kind = 'authored_by'").join(ends, F.col("target") == F.col("_end")).select("agent", F.col("source").alias("node")).distinct()


def agents_for_node(edges: DataFrame) -> DataFrame:
    """(node, agent) of every authorship, whichever end the agent stands at."""
    own = edges.where("kind = 'authored_by'")
    both = own.select(F.col("source").alias("node"), F.col("target").alias("_end")).unionByName(own.select(F.col("target").alias("node"), F.col("source").alias("_end")))
    return both.where(F.col("_end").startswith("agent:")).select("node", bare_agent_id("_end").alias("agent")).distinct()


def node_detail(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, label, docs, agent) of selected nodes, with the least authoring agent."""
    first = agents_for_node(edges).groupBy("node").agg(F.min("agent").alias("agent"))
    chosen = nodes.join(ids.select(F.col("id").alias("_i")).distinct(), F.col("id") == F.col("_i"), "left_semi")
    return chosen.join(first, F.col("id") == F.col("node"), "left").select("id", "label", docs_or_placeholder("docs").alias("docs"), "agent")


def derive_child_ids(edges: DataFrame) -> DataFrame:
    """(id, child_ids): the targets of each node's containing edges, in order, repeats kept."""
    return edges.where("kind = 'contains'").groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_list("target")).alias("child_ids"))


def with_child_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with child_ids from the edges."""
    return nodes.drop("child_ids").join(derive_child_ids(edges), "id", "left").withColumn("child_ids", F.coalesce("child_ids", F.array().cast("array<string>")))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, files and the memory they are estimated to take."""
    n = nodes.agg(F.count("*").alias("node_count"), F.count_if(F.col("type") == "file").alias("file_count"))
    counts = n.join(edges.agg(F.count("*").alias("edge_count")))
    return counts.withColumn("memory_bytes", estimate_memory("node_count", "edge_count", "file_count"))


def has_children(nodes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(id, expandable) of the nodes, or of those of them in ``asked``: child_ids not empty, or named as a parent."""
    met = (nodes if asked is None else asked).join(_parents(nodes), F.col("id") == F.col("_p"), "left")
    return met.select("id", (F.coalesce(F.size("child_ids") > 0, F.lit(False)) | F.col("_p").isNotNull()).alias("expandable"))


def hierarchy_rows(nodes: DataFrame, expanded: DataFrame, show_agents: bool = True, max_depth: int = 100_000, kept: bool = False) -> DataFrame:
    """(row, id, depth, expandable, expanded): visible nodes in pre-order; a node shows if all its ancestors are expanded.

    What lies directly below a shut node is left out before the tree is walked. Pre-order is the order of the ancestor paths, which are dealt into ranges, so no task orders a whole tree. ``kept``: the nodes are written
    already, and aren't written again.
    """
    nodes = agent_layer(nodes, show_agents).select("id", "parent_id", "child_ids")
    nodes = nodes if kept else stored(nodes)
    open_ = stored(expanded.select(F.col("id").alias("_e")).distinct())
    asked = stored(nodes.where("parent_id is null").unionByName(nodes.join(open_, F.col("parent_id") == F.col("_e"), "left_semi")))
    # A node that has something shut further above it ends below an absent parent, not below a root.
    rooted = ancestor_paths(asked, max_depth, kept=True).join(asked.where("parent_id is null").select(F.col("id").alias("_root")), F.element_at("path", 1) == F.col("_root"), "left_semi")
    flagged = rooted.join(has_children(nodes, asked), "id").join(open_, F.col("id") == F.col("_e"), "left")
    shown = stored(flagged.select("path", "expandable", F.col("_e").isNotNull().alias("expanded")))
    # Ranges of paths are numbered each on its own, and a running count over the ranges, as many as partitions, shifts them.
    ranged = stored(shown.repartitionByRange("path").withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.min("path").alias("_least"))
    shift = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_least").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).select("_range", "_before")
    placed = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy("path"))).join(shift, "_range")
    return placed.select((F.col("_before") + F.col("_k") - 1).cast("long").alias("row"), F.element_at("path", -1).alias("id"), (F.size("path") - 1).alias("depth"), "expandable", "expanded")
