"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

The leaves of the tree are (domain, language, source). A token budget flows down it: the children of a node share its budget by weight, a child that can't
use its share (its leaves hold fewer tokens, even over ``max_epochs`` epochs) passes the shortage to its siblings by their weights, and only what a whole subtree can't use goes
back to the siblings of its ancestor. A leaf then takes the longest prefix, within its budget, of an endless stream: all its documents in an order seeded
per epoch, epoch after epoch. All shares are whole numbers, so the result doesn't depend on how the data are dealt out.

The last epoch's prefix is found without sorting a leaf: tokens are summed by the first four hex digits of the order's key, the running sum names one of these
65,536 ranges, and only that range is ordered. A document is then chosen by comparing its key with its leaf's last key.

Edge cases: null domain, language or source is a leaf named ''; null or empty text has no tokens and goes with the prefix that its key falls in; leaves
without tokens give nothing; rows that share a doc_id and a leaf share a key and stand or fall together; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

LEAF = ("domain", "lang", "source")


@dataclass(frozen=True)
class MixParams:
    """percent: budget in percent of all tokens; weights of what isn't named: 1 in all; broadcast_leaves: up to so many leaves are broadcast."""

    percent: int = 70
    max_epochs: int = 2
    seed: str = "mix-1"
    domain: str = "concat('domain', cast(coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) as int), 0) % 3 as string))"
    domains: dict = field(default_factory=lambda: {"domain0": 40, "domain1": 35, "domain2": 25})
    langs: dict = field(default_factory=lambda: {"en": 55, "de": 15, "fr": 15, "es": 15})
    sources: dict = field(default_factory=dict)
    broadcast_leaves: int = 50_000


def _weight(column: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("decimal(10,0)")


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` (parent columns, name, capacity, weight, budget of the parent) with ``share``: water filling within each parent.

    In order of capacity per weight, a child is filled whole as long as that takes no more than its weight's part of what is left; the others divide the rest.
    """
    by = Window.partitionBy(*parent, F.lit(0)).orderBy(F.col("capacity").cast("double") / F.col("weight").cast("double"), name)
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent, F.lit(0))
    big = lambda c: c.cast("decimal(19,0)")
    filled = children.where("weight > 0").withColumn("_before", F.coalesce(F.sum("capacity").over(before), F.lit(0).cast("decimal(19,0)"))).withColumn("_after", F.sum("weight").over(after))
    filled = filled.withColumn("_full", big(F.col("capacity")) * big(F.col("_after")) <= (big(F.col("budget")) - big(F.col("_before"))) * big(F.col("weight")))
    rest = filled.withColumn("_used", F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(whole), F.lit(0))).withColumn("_left", F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole))
    part = F.expr("(cast(budget - _used as decimal(19,0)) * cast(weight as decimal(19,0))) div cast(_left as decimal(19,0))")
    return rest.withColumn("share", F.when(F.col("_full"), F.col("capacity").cast("long")).otherwise(part.cast("long"))).drop("_before", "_after", "_full", "_used", "_left", "budget")


def leaf_budgets(sizes: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """(domain, lang, source, n, share): tokens that each leaf holds and is to give. ``sizes`` has the leaf columns and n_tokens."""
    p = params
    total = lambda c: F.sum(c).cast("decimal(19,0)")
    leaves = cut(sizes.groupBy(*LEAF).agg(total("n_tokens").alias("n")).where("n > 0").withColumn("capacity", (F.col("n") * p.max_epochs).cast("decimal(19,0)")))
    langs = leaves.groupBy("domain", "lang").agg(total("capacity").alias("capacity"))
    domains = leaves.groupBy("domain").agg(total("capacity").alias("capacity"))
    budget = leaves.agg(F.expr(f"cast((sum(n) * {p.percent}) div 100 as decimal(19,0))").alias("budget"))
    top = share_out(domains.crossJoin(F.broadcast(budget)).withColumn("weight", _weight("domain", p.domains)), [], "domain")
    given = lambda df, keys: df.select(*keys, F.col("share").cast("decimal(19,0)").alias("budget"))
    middle = share_out(langs.join(given(top, ["domain"]), "domain").withColumn("weight", _weight("lang", p.langs)), ["domain"], "lang")
    low = share_out(leaves.join(given(middle, ["domain", "lang"]), ["domain", "lang"]).withColumn("weight", _weight("source", p.sources)), ["domain", "lang"], "source")
    return low.select(*LEAF, F.col("n").cast("long").alias("n"), "share")


def _key(params: MixParams, epoch: Column) -> Column:
    """The place of a document in the order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(params.seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def leaf_cuts(sizes: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """(domain, lang, source, full, last): whole epochs that each leaf gives, and the first key of the next epoch that it doesn't."""
    budgets = leaf_budgets(sizes, params).withColumn("full", F.expr("share div n")).withColumn("rest", F.expr("share - (share div n) * n"))
    budgets = _small(cut(budgets), params)
    keyed = sizes.join(budgets.where("rest > 0"), list(LEAF)).withColumn("key", _key(params, F.col("full"))).withColumn("range", F.substring("key", 1, 4))
    ranges = keyed.groupBy(*LEAF, "range").agg(F.sum("n_tokens").alias("in_range"), F.first("rest").alias("rest"))
    ordered = Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("before", F.sum("in_range").over(ordered) - F.col("in_range")).where("before <= rest and before + in_range > rest")
    own = keyed.select(*LEAF, "range", "key", "n_tokens").join(_small(ranges.select(*LEAF, "range", "before", "rest"), params), [*LEAF, "range"])
    peers = Window.partitionBy(*LEAF).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = own.withColumn("reached", F.col("before") + F.sum("n_tokens").over(peers)).where("reached > rest").groupBy(*LEAF).agg(F.min("key").alias("last"))
    return cut(budgets.select(*LEAF, "full").join(last, list(LEAF), "left").withColumn("last", F.coalesce("last", F.lit(""))))


def _small(df: DataFrame, params: MixParams) -> DataFrame:
    """One row per leaf: broadcast if counted to be few, else joined as Spark sees fit."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= params.broadcast_leaves else df


def leaf_columns(params: MixParams = MixParams()) -> list[Column]:
    """The leaf of a document."""
    return [F.coalesce(F.expr(params.domain), F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")]


def token_counts(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens): the words of each document."""
    trimmed = r"regexp_replace(coalesce(text, ''), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '')"
    n = F.expr(rf"if({trimmed} = '', 0L, cast(size(split({trimmed}, '[\\x20\\x09-\\x0D]+', -1)) as bigint))")
    return docs.select("doc_id", *leaf_columns(params), n.alias("n_tokens"))


def _chosen(rows: DataFrame, cuts: DataFrame, params: MixParams) -> DataFrame:
    """``rows`` (doc_id and the leaf columns) once for each epoch that takes them, with column epoch."""
    met = rows.join(_small(cuts, params), list(LEAF)).withColumn("epoch", F.explode(F.expr("sequence(0, full)")))
    return met.where((F.col("epoch") < F.col("full")) | (_key(params, F.col("full")) < F.col("last"))).drop("full", "last")


def mix_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The rows of ``docs``, once for each epoch that takes them, with their own columns. Texts are never shuffled."""
    cuts = leaf_cuts(cut(token_counts(docs, params)), params)
    whole = docs.select("doc_id", *leaf_columns(params), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return _chosen(whole, cuts, params).select("_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch) of every choice."""
    sizes = cut(token_counts(table(spark, sf_dir, "documents")))
    return _chosen(sizes, leaf_cuts(sizes), MixParams()).select("doc_id", *LEAF, "n_tokens", F.col("epoch").cast("long").alias("epoch"))


def mix_sql(documents: str = "documents", params: MixParams = MixParams(), columns: str = "") -> str:
    """The same choice in DuckDB SQL."""
    p = params
    case = lambda c, w: f"CAST(CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in w.items()) + " ELSE 1 END AS HUGEINT)" if w else "CAST(1 AS HUGEINT)"

    def shared(children: str, parent: str, name: str) -> str:
        by = f"PARTITION BY {parent} " if parent else ""
        return f"""
        (SELECT * EXCLUDE (fl, bf, af), CASE WHEN fl THEN capacity ELSE (budget - coalesce(sum(CASE WHEN fl THEN capacity END) OVER (PARTITION BY {parent or 1}), 0)) * weight
              // sum(CASE WHEN NOT fl THEN weight END) OVER (PARTITION BY {parent or 1}) END AS share
         FROM (SELECT *, capacity * af <= (budget - bf) * weight AS fl
               FROM (SELECT *, coalesce(sum(capacity) OVER (ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf, sum(weight) OVER (ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS af
                     FROM ({children}) WHERE weight > 0 WINDOW ord AS ({by}ORDER BY CAST(capacity AS DOUBLE) / CAST(weight AS DOUBLE), {name}))))"""

    domain = "'domain' || CAST(coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS INTEGER), 0) % 3 AS VARCHAR)"
    key = f"md5('{p.seed}:' || CAST(full_epochs AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))"
    return f"""
    WITH sizes AS (SELECT doc_id{columns}, coalesce({domain}, '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM {documents}),
    leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS n, CAST(sum(n_tokens) * {p.max_epochs} AS HUGEINT) AS capacity FROM sizes GROUP BY ALL HAVING sum(n_tokens) > 0),
    top AS (SELECT * FROM {shared(f"SELECT domain, sum(capacity) AS capacity, {case('domain', p.domains)} AS weight, (SELECT sum(n) * {p.percent} // 100 FROM leaves) AS budget FROM leaves GROUP BY domain", "", "domain")}),
    middle AS (SELECT * FROM {shared(f"SELECT l.domain, l.lang, sum(l.capacity) AS capacity, {case('l.lang', p.langs)} AS weight, any_value(t.share) AS budget FROM leaves l JOIN top t ON l.domain = t.domain GROUP BY l.domain, l.lang", "domain", "lang")}),
    low AS (SELECT * FROM {shared(f"SELECT l.domain, l.lang, l.source, l.n, l.capacity, {case('l.source', p.sources)} AS weight, t.share AS budget FROM leaves l JOIN middle t ON l.domain = t.domain AND l.lang = t.lang", "domain, lang", "source")}),
    keyed AS (SELECT s.*, full_epochs, rest, {key} AS k FROM sizes s JOIN (SELECT domain, lang, source, share // n AS full_epochs, share - (share // n) * n AS rest FROM low) USING (domain, lang, source)),
    placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached FROM keyed),
    chosen AS (SELECT *, unnest(range(0, CAST(full_epochs AS BIGINT) + 1)) AS epoch FROM placed)
    SELECT doc_id{columns}, domain, lang, source, n_tokens, epoch FROM chosen WHERE epoch < full_epochs OR (rest > 0 AND reached <= rest)"""
