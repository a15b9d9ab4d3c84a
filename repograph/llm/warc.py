"""WARC fixity audit of replicas by Merkle trees.

A record's leaf is the SHA-256 of its bytes. A node covers the records of a range of ids, ``fanout`` times as wide on each level, and hashes its children's hashes in order with their
places and the lengths of their offset ranges, so it covers the offsets of all its records from its own first byte on, and a record that is missing, added or changed in length touches only its own branch. Every node also holds the range of offsets that
its records take in the archive. Replicas are compared from the root down: a level's nodes are read only below parents that differ, and what differs at the leaves is the damage.

Offsets are running sums over the ids, taken per range of ids first, so no task orders the whole archive.

Edge cases: null ids stand before all others as one place; records that share an id make one leaf of their sorted hashes; null url or html are empty; an empty table has no
nodes, and against it every record is missing or extra; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

RANGE = 1 << 16
NO_ID = -(1 << 62)  # the place of records without an id


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The text of a WARC response record of a page."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(records: DataFrame, record_id: str = "page_id", record: str = "record") -> DataFrame:
    """(node, hash, first, end, records): one leaf per id, with the offsets of its records in an archive ordered by id."""
    own = records.select(F.coalesce(F.col(record_id).cast("long"), F.lit(NO_ID)).alias("node"), F.sha2(record, 256).alias("hash"), F.octet_length(record).cast("long").alias("size"))
    by_id = own.groupBy("node").agg(F.array_join(F.sort_array(F.collect_list("hash")), ",").alias("hashes"), F.sum("size").alias("size"), F.count("*").alias("records"))
    by_id = cut(by_id.withColumn("hash", F.when(F.col("records") == 1, F.col("hashes")).otherwise(F.sha2("hashes", 256))).drop("hashes").withColumn("range", F.floor(F.col("node") / RANGE)))
    ranges = by_id.groupBy("range").agg(F.sum("size").alias("in_range"))
    before = ranges.select("range", (F.sum("in_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_range")).alias("before"))
    place = Window.partitionBy("range").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    placed = by_id.join(before, "range").withColumn("end", F.col("before") + F.sum("size").over(place))
    return placed.select("node", "hash", (F.col("end") - F.col("size")).alias("first"), "end", "records")


def tree(records: DataFrame, levels: int, fanout: int = 64, record_id: str = "page_id", record: str = "record") -> list[DataFrame]:
    """The levels of a replica's tree, leaves first."""
    out = [cut(leaves(records, record_id, record))]
    for _ in range(levels):
        child = F.struct("node", (F.col("end") - F.col("first")).alias("length"), "hash")
        told = F.array_join(F.transform(F.sort_array(F.collect_list(child)), lambda x: F.concat_ws(":", x["node"].cast("string"), x["length"].cast("string"), x["hash"])), ",")
        up = out[-1].groupBy(F.floor(F.col("node") / fanout).alias("parent")).agg(F.sha2(told, 256).alias("hash"), F.min("first").alias("first"), F.max("end").alias("end"), F.sum("records").alias("records"))
        out.append(cut(up.withColumnRenamed("parent", "node")))
    return out


def levels_for(records: DataFrame, fanout: int = 64, record_id: str = "page_id") -> int:
    """Levels above the leaves until at most two nodes are left, which cover the ids below and above zero."""
    far = records.agg(F.max(F.abs(F.col(record_id).cast("long")))).first()[0] or 1
    n = 1
    while fanout**n <= far:
        n += 1
    return n


def audit(one: list[DataFrame], two: list[DataFrame], fanout: int = 64) -> DataFrame:
    """(node, kind, first, end, hash_one, hash_two, level_reads): the leaves in which two replicas' trees differ; offsets are the first replica's, for extra ones the second's."""
    wanted = None
    for level in range(len(one) - 1, -1, -1):
        a, b = one[level], two[level]
        if wanted is not None:
            below = lambda df: df.withColumn("_up", F.floor(F.col("node") / fanout)).join(wanted, F.col("_up") == wanted["up"], "left_semi").drop("_up")  # noqa: B023, E731
            a, b = below(a), below(b)
        a = a.select("node", F.col("hash").alias("hash_one"), F.col("first").alias("first_one"), F.col("end").alias("end_one"))
        b = b.select("node", F.col("hash").alias("hash_two"), F.col("first").alias("first_two"), F.col("end").alias("end_two"))
        differ = cut(a.join(b, "node", "full").where(~F.col("hash_one").eqNullSafe(F.col("hash_two"))))
        wanted = differ.select(F.col("node").alias("up"))
    kind = F.when(F.col("hash_two").isNull(), "missing").when(F.col("hash_one").isNull(), "extra").otherwise("changed")
    return differ.select("node", kind.alias("kind"), F.coalesce("first_one", "first_two").alias("first"), F.coalesce("end_one", "end_two").alias("end"), "hash_one", "hash_two")


def op4_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the pages' archive against a replica in which some records are damaged, some lost and some added, by rules on page_id."""
    pages = table(spark, sf_dir, "pages")
    source = pages.select("page_id", warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    damaged = F.when(F.col("page_id") % 53 == 7, F.concat(F.expr("left(record, length(record) - 5)"), F.lit("?"), F.expr("right(record, 4)"))).otherwise(F.col("record"))
    replica = source.where("page_id is null or page_id % 101 <> 11").select("page_id", damaged.alias("record"))
    added = source.where("page_id % 211 = 5").select((-1 - F.col("page_id")).alias("page_id"), "record")
    replica = replica.unionByName(added)
    levels = levels_for(pages)
    found = audit(tree(source, levels), tree(replica, levels))
    return found.select(F.nullif(F.col("node"), F.lit(NO_ID)).alias("page_id"), "kind", F.col("first").alias("first_byte"), F.col("end").alias("end_byte"), "hash_one", "hash_two")


def _leaf_sql(records: str) -> str:
    return f"""SELECT page_id, coalesce(page_id, {NO_ID}) AS place, h, n, CAST(sum(n) OVER (ORDER BY coalesce(page_id, {NO_ID})) AS BIGINT) AS e FROM
        (SELECT page_id, CASE WHEN count(*) = 1 THEN any_value(h) ELSE sha256(string_agg(h, ',' ORDER BY h)) END AS h, CAST(sum(n) AS BIGINT) AS n FROM (SELECT page_id, sha256(record) AS h, strlen(record) AS n FROM {records}) GROUP BY page_id)"""


_RECORD = (
    "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')"
    " || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"
)
OP4_SQL = f"""
WITH source AS (SELECT page_id, {_RECORD} AS record FROM pages),
replica AS (SELECT page_id, CASE WHEN page_id % 53 = 7 THEN left(record, length(record) - 5) || '?' || right(record, 4) ELSE record END AS record FROM source WHERE page_id IS NULL OR page_id % 101 <> 11
            UNION ALL SELECT -1 - page_id, record FROM source WHERE page_id % 211 = 5),
a AS ({_leaf_sql("source")}), b AS ({_leaf_sql("replica")})
SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'extra' ELSE 'changed' END AS kind,
       coalesce(a.e - a.n, b.e - b.n) AS first_byte, coalesce(a.e, b.e) AS end_byte, a.h AS hash_one, b.h AS hash_two
FROM a FULL JOIN b ON a.place = b.place WHERE a.h IS DISTINCT FROM b.h"""
