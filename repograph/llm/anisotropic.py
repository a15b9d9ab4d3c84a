"""Approximate nearest neighbours by score-aware (anisotropic) product quantisation, four-bit table scans and exact reranking.

Smallest Euclidean distance is largest inner product of (q, -1) with (x, |x|^2 / 2), so vectors are quantised for inner products: the loss of a vector weighs
the part of its residual that is parallel to it ``eta`` times as much as the rest, because that part moves the scores of the queries for which the
vector ranks high. Codes are four bits for each pair of dimensions; the norm term is kept exactly. Vectors are dealt into cells of their nearest centre, codes are of the residual to it.
A query scans the codes of the cells that it probes through two-nibble tables, and in each piece of a cell the best ``rerank`` distinct scores are measured exactly.

Centres, codebooks and the number of probes are fitted on a sample of at most ``sample`` vectors (those of least hash), the only bound that
doesn't follow the data; every vector is indexed. The probes are the fewest that find ``recall`` of the sample's true neighbours. Cells of more than ``block`` rows
are dealt into pieces, and a query goes to each piece, so a vector that fills a third of the table is scanned by many tasks; all rows of one score are measured together,
so repeated vectors don't crowd out others. Pieces return ten rows a query, which are ranked by distance and vec_id. Probes and codes are fitted on rows of the table, and queries or
rows unlike them lose neighbours, so an exact check follows: the distance of the last row found bounds what can still be nearer, the triangle inequality drops cells beyond that bound
(each with the least and largest distance of its rows from the centre), and in all others every row is held against the bound in double precision, with an allowance for rounding. What is
returned are the true neighbours. A query that gets fewer than ``k`` has no bound and goes to all cells, so it gets ``k`` rows or all candidates. Where vectors don't gather round centres, the
check visits most cells, and its time grows with queries times rows; memory is that of a piece. Cells, codes and scores are of vectors divided by a power of two near the table's largest component, so that squares stay finite.

Edge cases: vectors that are null, zero, of another dimension than most, or hold null or non-finite components take no part; rows that share a vec_id count
once, at their nearest; a query whose vec_id has several vectors uses the least of them; fewer candidates than ``k`` are all returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, table
from .near_dedup import _grouped


@dataclass(frozen=True)
class SearchParams:
    """cell: rows of a cell on average, at most ``cells`` of them; threshold: inner product, as a share of the norms, from which scores matter."""

    k: int = 10
    sample: int = 20_000
    cell: int = 1000
    cells: int = 4096
    block: int = 8192
    rerank: int = 64
    threshold: float = 0.35
    recall: float = 0.985
    rounds: int = 6


@dataclass
class Index:
    """What is broadcast: centres (n, d), codebooks (d / 2, 16, 2) and the number of cells that a query probes."""

    centres: np.ndarray
    books: np.ndarray
    probes: int

    def residual_pairs(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        r = x - self.centres[cell]
        if r.shape[1] % 2:
            r = np.pad(r, ((0, 0), (0, 1)))
        return r.reshape(len(r), -1, 2)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Cells by distance for each query, nearest first."""
        return np.argsort((self.centres**2).sum(axis=1)[None] - 2 * q @ self.centres.T, axis=1, kind="stable")


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([((centres**2).sum(1)[None] - 2 * x[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(x), 4096)])
        counts = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres).astype(np.float32)
    return centres


def _directions(x: np.ndarray) -> np.ndarray:
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    return (np.pad(u, ((0, 0), (0, 1))) if u.shape[1] % 2 else u).reshape(len(u), -1, 2)


def assign_codes(pairs: np.ndarray, u: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes (n, m) of residual pairs by coordinate descent on |r|^2 + (eta - 1) (r . u)^2; u is the unit vector of the whole datapoint."""
    m = books.shape[0]
    codes = np.stack([((books[j] ** 2).sum(1)[None] - 2 * pairs[:, j] @ books[j].T).argmin(1) for j in range(m)], axis=1)
    left = pairs - books[np.arange(m)[None], codes]
    parallel = np.einsum("njd,njd->n", left, u)
    for _ in range(sweeps):
        for j in range(m):
            others = parallel - (left[:, j] * u[:, j]).sum(1)
            r = pairs[:, j, None, :] - books[j][None]
            best = ((r**2).sum(2) + (eta - 1) * (others[:, None] + np.einsum("ncd,nd->nc", r, u[:, j])) ** 2).argmin(1)
            codes[:, j], left[:, j] = best, pairs[:, j] - books[j][best]
            parallel = others + (left[:, j] * u[:, j]).sum(1)
    return codes.astype(np.uint8)


def _update(pairs: np.ndarray, u: np.ndarray, codes: np.ndarray, books: np.ndarray, eta: float) -> np.ndarray:
    """Codebooks that minimise the same loss for given codes, one pair of dimensions at a time: each codeword solves a 2 x 2 system."""
    m = books.shape[0]
    books = books.copy()
    parallel = np.einsum("njd,njd->n", pairs - books[np.arange(m)[None], codes], u)
    for j in range(m):
        own = ((pairs[:, j] - books[j][codes[:, j]]) * u[:, j]).sum(1)
        others = parallel - own
        uj, c = u[:, j], codes[:, j]
        weight = np.eye(2)[None] + (eta - 1) * uj[:, :, None] * uj[:, None, :]
        goal = np.einsum("nde,ne->nd", weight, pairs[:, j]) + (eta - 1) * others[:, None] * uj
        for w in range(16):
            mine = c == w
            if mine.any():
                books[j, w] = np.linalg.solve(weight[mine].sum(0) + 1e-9 * np.eye(2), goal[mine].sum(0))
        parallel = others + ((pairs[:, j] - books[j][c]) * uj).sum(1)
    return books.astype(np.float32)


def fit_index(sample: np.ndarray, rows: int, params: SearchParams = SearchParams(), seed: int = 7) -> Index:
    """Centres, codebooks and probes from a sample of vectors; ``rows`` is the size of the whole table."""
    p, rng = params, np.random.default_rng(seed)
    x = sample.astype(np.float32)
    n, d = x.shape
    centres = _kmeans(x, max(1, min(p.cells, rows // p.cell, n)), rng)
    index = Index(centres, np.zeros(((d + 1) // 2, 16, 2), dtype=np.float32), len(centres))
    cell = np.concatenate([index.order(x[i : i + 4096])[:, 0] for i in range(0, n, 4096)])
    pairs, u = index.residual_pairs(x, cell), _directions(x)
    t = p.threshold
    eta = max(1.0, (d - 1) * t * t / (1 - t * t))
    few = rng.choice(n, min(n, 8000), replace=False)
    index.books = np.stack([np.pad(_kmeans(pairs[few, j], min(16, len(few)), rng), ((0, 16 - min(16, len(few))), (0, 0)), mode="edge") for j in range(pairs.shape[1])])
    for _ in range(p.rounds):
        codes = assign_codes(pairs[few], u[few], index.books, eta, 1)
        index.books = _update(pairs[few], u[few], codes, index.books, eta)
    ask = rng.choice(n, min(n, 256), replace=False)
    distance = (x**2).sum(1)[None] - 2 * x[ask] @ x.T
    distance[np.arange(len(ask)), ask] = np.inf
    true = np.argpartition(distance, min(p.k, n - 1) - 1 if n > 1 else 0, axis=1)[:, : min(p.k, n - 1)]
    if true.size:
        place = np.argsort(index.order(x[ask]), axis=1)  # rank of each cell for each query
        ranks = np.sort(np.take_along_axis(place, cell[true], axis=1).ravel())
        index.probes = int(ranks[min(len(ranks) - 1, int(np.ceil(p.recall * len(ranks))) - 1)]) + 1
    return index


def _usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda v: v != 0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def nearest(vectors: DataFrame, queries: DataFrame, params: SearchParams = SearchParams(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``vectors`` found for each row of ``queries`` (both vec_id, embedding), other than its own id."""
    p, spark = params, vectors.sparkSession
    # Vectors travel as they are given; only codes and cells are found in single precision.
    kind, width = ("float", "<f4") if vectors.schema[embedding].dataType.elementType.typeName() == "float" else ("double", "<f8")
    clean = lambda df: df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("v")).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    all_rows = clean(vectors)
    sizes = all_rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d, n, most = sizes[0]["d"], sizes[0]["n"], float(sizes[0]["most"])
    scale = float(2.0 ** np.floor(np.log2(most)))
    all_rows = all_rows.where(F.size("v") == d)
    asked = clean(queries).where(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v"))
    sample = all_rows.select("v").orderBy(F.xxhash64("vec_id"), "v").limit(p.sample).toPandas()["v"]
    index = spark.sparkContext.broadcast(fit_index(np.stack(sample.to_numpy()).astype(np.float64) / scale, n, p))
    t = p.threshold
    eta = max(1.0, (d - 1) * t * t / (1 - t * t))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column(1), d)
                low = (x / scale).astype(np.float32)
                cell = ix.order(low)[:, 0]
                codes = assign_codes(ix.residual_pairs(low, cell), _directions(low), ix.books, eta)
                codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
                packed = codes[:, 0::2] | (codes[:, 1::2] << 4)
                away = np.sqrt(((x.astype(np.float64) / scale - ix.centres[cell]) ** 2).sum(axis=1))
                yield pa.record_batch([part.column(0), pa.array(cell.astype(np.int32)), pa.array(away), pa.array([c.tobytes() for c in packed], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "cell", "away", "code", "v"])

    placed = cut(all_rows.mapInArrow(place, "id long, cell int, away double, code binary, v binary"))
    shells = placed.groupBy("cell").agg(F.count("*").alias("_n"), F.min("away").alias("least"), F.max("away").alias("most"))
    pieces = cut(shells.select("cell", F.ceil(F.col("_n") / p.block).cast("int").alias("_g"), "least", "most"))  # at most ``cells`` rows
    rows = placed.join(F.broadcast(pieces.select("cell", "_g")), "cell").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("_g").cast("long")).cast("int"))
    shell = np.full((2, len(index.value.centres)), np.inf)
    for row in pieces.collect():
        shell[:, row["cell"]] = row["least"], row["most"]

    def probe(batches: Iterator[pa.RecordBatch], check: bool) -> Iterator[pa.RecordBatch]:
        """Each query with the cells that it probes, or with those that can hold rows within its bound."""
        ix = index.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = _matrix(part.column(1), d)
                bound = part.column(2).to_numpy(zero_copy_only=False)
                if check:
                    query, cells = np.nonzero(_within(x.astype(np.float64) / scale, ix.centres.astype(np.float64), shell, bound / scale))
                else:
                    cells = ix.order((x / scale).astype(np.float32))[:, : ix.probes]
                    query, cells = np.repeat(np.arange(len(x)), cells.shape[1]), cells.ravel()
                row = pa.array(query)
                raw = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.record_batch([part.column(0).take(row), pa.array(cells.astype(np.int32)), raw.take(row), part.column(2).take(row)], names=["id", "cell", "v", "bound"])

    def scan(batches: Iterator[pa.RecordBatch], check: bool) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for t in _grouped(batches, "spot"):
            spot, side, ids, bound = (t.column(c).to_numpy() for c in ("spot", "side", "id", "bound"))
            bounds = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1], [True]]))
            for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                split = b + int((side[b:e] == 0).sum())
                if split == b or split == e:
                    continue
                raw = t.column("v").slice(b, e - b).combine_chunks().to_pylist()
                v = np.frombuffer(b"".join(raw), dtype=width).reshape(e - b, d)
                if check:
                    yield _checked(ids[b:split], v[: split - b], bound[b:split], ids[split:e], v[split - b :], ix.centres[int(spot[b] >> 31)].astype(np.float64), p, scale)
                    continue
                code = np.frombuffer(b"".join(t.column("code").slice(split, e - split).combine_chunks().to_pylist()), dtype=np.uint8).reshape(e - split, -1)
                yield _scan(ids[b:split], v[: split - b], ids[split:e], v[split - b :], code, ix, int(spot[b] >> 31), p, scale)

    def answers(queries: DataFrame, check: bool) -> DataFrame:
        """(query_id, vec_id, score): the nearest of the cells that each query (vec_id, v, bound) probes, or the nearest within its bound."""
        probes = queries.repartition(shuffle_partitions(spark)).mapInArrow(lambda batches: probe(batches, check), "id long, cell int, v binary, bound double")
        probes = probes.join(F.broadcast(pieces.select("cell", "_g")), "cell").withColumn("piece", F.explode(F.expr("sequence(0, _g - 1)")))
        code = F.lit(None).cast("binary").alias("code")
        both = rows.select("cell", "piece", F.lit(1).alias("side"), "id", code if check else F.col("code"), "v", F.lit(0.0).alias("bound")).unionByName(probes.select("cell", "piece", F.lit(0).alias("side"), "id", code, "v", "bound"))
        both = both.withColumn("spot", F.col("cell").cast("long") * (1 << 31) + F.col("piece"))
        dealt = both.select("spot", "side", "id", "code", "v", "bound").repartition(max(shuffle_partitions(spark), 2), "spot").sortWithinPartitions("spot", "side", "id")
        found = dealt.mapInArrow(lambda batches: scan(batches, check), "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    def first(best: DataFrame) -> DataFrame:
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
        return ranked.where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")

    best = cut(first(answers(asked.withColumn("bound", F.lit(float("inf"))), False)))
    last = best.where(F.col("rank") == p.k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    bounded = asked.join(last, "vec_id", "left").select("vec_id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    every = best.select("query_id", "vec_id", "score").unionByName(answers(bounded, True))
    return first(every.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of the rows of ``a`` from those of ``b``, and what rounding can have changed them by."""
    whole = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None]
    return whole - 2 * a @ b.T, 8 * (a.shape[1] + 8) * np.finfo(np.float64).eps * whole


def _within(q: np.ndarray, centres: np.ndarray, shell: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each query and cell whether a row between the cell's least and largest distance from its centre can be within the query's bound."""
    square, error = _squares(q, centres)
    low, high = np.sqrt(np.maximum(square - error, 0)), np.sqrt(np.maximum(square + error, 0))
    near = np.maximum(low - shell[1] * (1 + 1e-9), shell[0] * (1 - 1e-9) - high)
    return (near <= (bound * (1 + 1e-9))[:, None]) & np.isfinite(shell[0])[None]


def _checked(q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, ids: np.ndarray, x: np.ndarray, centre: np.ndarray, p: SearchParams, scale: float) -> pa.RecordBatch:
    """The nearest rows of one piece of a cell within each query's bound."""
    exact = x.astype(np.float64)
    moved = exact / scale - centre
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), 128):
        square, error = _squares(q[at : at + 128].astype(np.float64) / scale - centre, moved)
        close = square - error <= (bound[at : at + 128, None] / scale * (1 + 1e-9)) ** 2
        for k in np.flatnonzero(close.any(axis=1)):
            out.append(_measured(q_ids[at + k], q[at + k], ids, exact, np.flatnonzero(close[k]), p, scale))
    if not out:
        out = [(q_ids[:0], ids[:0], np.zeros(0))]
    return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])


def _measured(q_id: int, one: np.ndarray, ids: np.ndarray, exact: np.ndarray, some: np.ndarray, p: SearchParams, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest of some rows for a query, measured on the vectors as they are given."""
    unit = scale if not 2.0**-400 < scale < 2.0**400 else 1.0  # squares of differences stay in range; dividing by a power of two is exact
    some = some[ids[some] != q_id]
    distance = np.sqrt(((exact[some] / unit - one.astype(np.float64) / unit) ** 2).sum(axis=1)) * unit
    order = np.lexsort((ids[some], distance))
    if len(order) > p.k:
        _, first = np.unique(ids[some][order], return_index=True)  # rows that share a vec_id count once
        order = order[np.sort(first)][: p.k]
    return np.full(len(order), q_id), ids[some][order], distance[order]


def _scan(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, code: np.ndarray, index: Index, cell: int, p: SearchParams, scale: float) -> pa.RecordBatch:
    """The nearest rows of one piece of a cell for each query that probes it."""
    exact = x.astype(np.float64)
    half = ((exact / scale) ** 2).sum(axis=1) / 2
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    m = index.books.shape[0]
    at = code.T.astype(np.intp)
    for k, one in enumerate(q):
        low_q = (one / scale).astype(np.float32)
        pairs = np.pad(low_q, (0, 2 * m - len(one))).reshape(m, 2)
        low = np.einsum("jcd,jd->jc", index.books, pairs)
        if m % 2:
            low = np.concatenate([low, np.zeros((1, 16), dtype=low.dtype)])
        tables = (low[1::2, :, None] + low[0::2, None, :]).reshape(len(low) // 2, 256)  # a byte holds two nibbles
        score = float(low_q @ index.centres[cell]) - half
        for j in range(len(tables)):
            score = score + tables[j].take(at[j])
        score[ids == q_ids[k]] = -np.inf
        some = np.arange(len(ids))
        if len(ids) > p.rerank:
            top = np.unique(score)
            some = np.flatnonzero(score >= top[max(0, len(top) - p.rerank)])
        out.append(_measured(q_ids[k], one, ids, exact, some, p, scale))
    return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every vector whose vec_id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
