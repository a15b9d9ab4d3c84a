"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are positives; what else is read is unlabelled, whatever its own label. A linear classifier in numpy is trained on the risk
prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with logistic loss: the class prior takes from the unlabelled risk what the positives among it
cause, and where that estimate would fall below zero its gradient is turned round. Features are the presence of words and of five-byte word beginnings that are much more frequent in positives
than in unlabelled texts. Two classifiers are fitted, each on one half of the learning rows; the labels of the other half give its class prior and calibrate its score, and the
mean of both probabilities is the score of a text. Every text is scored whole, in one pass without a shuffle.

Features are chosen by counts over all learning rows: in how many confirmed positives and how many texts in all each occurs; of the features of positives the ``candidates`` most frequent are counted in all texts. The gradient
fit uses at most ``most`` positives, unlabelled and calibration documents of each half (those of least hash of doc_id, of rows that share an id the least text), a documented bound; only labels of learning rows are read.

Edge cases: null and empty texts have no features and get the score of the bias alone; null doc_ids are scored but never learnt from; without positives or in an empty table every score is 0;
repeated labels of a doc_id count as toxic if any does; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, table
from .shingles import _SPACE, mix, range_hashes, texts, word_ranges

_BREAKS = _SPACE.copy()
_BREAKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


@dataclass(frozen=True)
class ToxicParams:
    most: int = 6000
    candidates: int = 1 << 16
    features: int = 4096
    least_positives: int = 3
    rounds: int = 400
    rate: float = 0.05
    ridge: float = 1e-4
    slack: float = 0.0
    threshold: float = 0.7


@dataclass
class Scorer:
    """Broadcast: sorted feature hashes, and of each classifier the weights, the bias and the two calibration numbers."""

    names: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    slope: np.ndarray
    shift: np.ndarray

    def scores(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts from their (row, feature) pairs."""
        out = np.zeros(n)
        for w, b, s, t in zip(self.weights, self.bias, self.slope, self.shift):
            z = b + np.bincount(rows, weights=w[features], minlength=n)
            out += 1 / (1 + np.exp(-np.clip(s * z + t, -30, 30)))
        return out / max(len(self.bias), 1)


def _features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, number of rows, row, feature hash) of slices of a text column: whole words, and beginnings of words longer than five bytes."""
    for at, data, offsets in texts(column):
        starts, ends = word_ranges(data, offsets, _BREAKS)
        row = np.searchsorted(offsets, starts, side="right") - 1
        long = ends - starts > 5
        words, heads = range_hashes(data, (starts, ends), (starts[long], starts[long] + 5))
        yield at, len(offsets) - 1, np.concatenate([row, row[long]]), np.concatenate([words, mix(heads + np.uint64(5))])


def _present(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs without repeats."""
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
    return row[new], feature[new]


def _chosen(names: np.ndarray, row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in names) of the features that are in the sorted ``names``."""
    if not len(names) or not len(feature):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(names, feature), len(names) - 1)
    hit = names[at] == feature
    return _present(row[hit], at[hit])


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], n_features: int, prior: float, params: ToxicParams) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise the non-negative risk, by Adam over all rows; rows are arrays of feature numbers."""
    p = params
    rows = [*positive, *unlabelled]
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    is_p = np.arange(len(rows)) < len(positive)
    theta, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, p.rounds + 1):
        _, negative, of_positive, of_negative = nnpu_risk(theta, flat, owner, is_p, prior)
        # Where the negative part has fallen below zero, a step goes up its gradient alone.
        grad = of_positive + of_negative if negative >= -p.slack else -of_negative
        grad = grad + p.ridge * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def nnpu_risk(theta: np.ndarray, flat: np.ndarray, owner: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The parts prior * R_p(+) and R_u(-) - prior * R_p(-) of the risk, and the gradient of each; theta: weights and bias, (owner, flat): the features of the rows."""
    n, k = len(is_p), len(theta) - 1
    n_p, n_u = max(is_p.sum(), 1), max((~is_p).sum(), 1)
    z = theta[-1] + np.bincount(owner, weights=theta[flat], minlength=n)
    up = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = np.logaddexp(0, z)  # of calling a row negative
    positive = prior * np.logaddexp(0, -z)[is_p].sum() / n_p
    negative = loss[~is_p].sum() / n_u - prior * loss[is_p].sum() / n_p
    spread = lambda g: np.append(np.bincount(flat, weights=g[owner], minlength=k), g.sum())
    return positive, negative, spread(np.where(is_p, -prior * (1 - up) / n_p, 0.0)), spread(np.where(is_p, -prior * up / n_p, up / n_u))


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through labelled scores, by Newton's method with a small ridge; identity if a class is missing."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    a = np.stack([z, np.ones_like(z)], axis=1)
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (q * (1 - q))[:, None]).T @ a + 1e-6 * np.eye(2)
        w = w - np.linalg.solve(h, a.T @ (q - y) + 1e-6 * w)
        w = np.clip(w, -50, 50)
    return float(w[0]), float(w[1])


def _texts_of(docs: DataFrame, ids: DataFrame, marks: int = 1 << 20) -> DataFrame:
    """(text) of the rows of ``docs`` whose doc_id is among ``ids``. A table of at most ``marks`` remainders leaves out most others in the scan, so that their texts aren't shuffled for the exact join."""
    mark = crc_mod(F.col("doc_id"), marks).alias("_mark")
    likely = docs.select("doc_id", "text", mark).join(F.broadcast(ids.select(mark).distinct()), "_mark", "left_semi")
    return likely.join(ids, "doc_id", "left_semi").select("text")


def fit_scorer(docs: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams()) -> Scorer:
    """A scorer from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); the rows to learn from are those whose crc32 remainder by three isn't 1."""
    p = params
    fold = crc_mod(F.col("doc_id"), 3)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold).where("fold <> 1")
    first = lambda df: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.most)
    some = None
    for f in (0, 2):
        own = known.where(F.col("fold") == f)
        free = docs.where("doc_id is not null").select("doc_id").withColumn("fold", fold).where(F.col("fold") == f)
        for kind, ids in (("p", first(own.where("toxic = 1"))), ("c", first(own)), ("u", first(free))):
            part = ids.select("doc_id", F.lit(f).alias("fold"), F.lit(kind).alias("kind"), (F.col("toxic") if kind == "c" else F.lit(1 if kind == "p" else 0)).cast("int").alias("y"))
            some = part if some is None else some.unionByName(part)
    some = cut(some.distinct())  # at most six times ``most`` ids
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "fold", "kind", "y").agg(F.min("text").alias("text"))
    rows = cut(rows.select("fold", "kind", "y", "text"))
    if not rows.where("kind = 'p'").take(1):
        return Scorer(np.zeros(0, dtype=np.uint64), np.zeros((0, 0)), np.zeros(0), np.zeros(0), np.zeros(0))
    learning = docs.where("doc_id is not null").where(fold != 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, row, feature in _features(batch.column(0)):
                names, n = np.unique(_present(row, feature)[1], return_counts=True)
                yield pa.record_batch([pa.array(names.view(np.int64)), pa.array(n)], names=["name", "n"])

    positives = _texts_of(learning, known.where("toxic = 1").select("doc_id"))
    in_positives = positives.mapInArrow(count, "name long, n long").groupBy("name").agg(F.sum("n").alias("p")).where(F.col("p") >= p.least_positives)
    likely = in_positives.orderBy(F.desc("p"), "name").limit(p.candidates).toPandas()  # a bounded number of rows
    order = np.argsort(likely["name"].to_numpy(dtype=np.int64).view(np.uint64))
    tried, in_p = likely["name"].to_numpy(dtype=np.int64).view(np.uint64)[order], likely["p"].to_numpy(dtype=np.float64)[order]

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n_texts = np.zeros(len(tried), dtype=np.int64), 0
        for batch in batches:
            n_texts += batch.num_rows
            for _, _, row, feature in _features(batch.column(0)):
                total += np.bincount(_chosen(tried, row, feature)[1], minlength=len(tried))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n_texts))], names=["place", "n"])

    counted = learning.select("text").mapInArrow(among, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    totals = np.zeros(len(tried) + 1)
    totals[counted["place"].to_numpy(dtype=int)] = counted["n"].to_numpy(dtype=np.float64)
    n_p, in_all, n_all = positives.count(), totals[:-1], totals[-1]
    lift = np.log((in_p + 0.5) / (n_p + 1)) - np.log((in_all + 1) / (n_all + 2))
    names = np.sort(tried[np.lexsort((tried, -lift * np.sqrt(np.minimum(in_p, p.most))))[: p.features]])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, row, feature in _features(batch.column(3)):
                row, place = _chosen(names, row, feature)
                ends = np.searchsorted(row, np.arange(n + 1))
                lists = pa.array([place[b:e].astype("<u4").tobytes() for b, e in zip(ends[:-1], ends[1:])], pa.binary())
                yield pa.record_batch([*[batch.column(i).slice(at, n) for i in range(3)], lists], names=["fold", "kind", "y", "features"])

    data = rows.mapInArrow(pick, "fold int, kind string, y int, features binary").toPandas()
    data["features"] = [np.frombuffer(x, dtype="<u4").astype(np.int64) for x in data["features"]]
    weights, bias, slope, shift = [], [], [], []
    for f in (0, 2):
        own, other = data[data["fold"] == f], data[(data["fold"] != f) & (data["kind"] == "c")]
        positive, unlabelled = own[own["kind"] == "p"]["features"].tolist(), own[own["kind"] == "u"]["features"].tolist()
        if not positive or not unlabelled or not len(other):
            continue
        w, b = fit_nnpu(positive, unlabelled, len(names), float(np.clip(other["y"].mean(), 0.001, 0.9)), p)
        z = np.array([b + w[x].sum() for x in other["features"]])
        s, t = calibrate(z, other["y"].to_numpy(dtype=np.float64))
        weights.append(w), bias.append(b), slope.append(s), shift.append(t)
    return Scorer(names, np.array(weights), np.array(bias), np.array(slope), np.array(shift))


def score_texts(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            for at, n, row, feature in _features(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(at, n), pa.array(s.scores(*_chosen(s.names, row, feature), n))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; held-out rows are those whose labels were not read."""
    docs, p = table(spark, sf_dir, "documents"), ToxicParams()
    scored = score_texts(docs, fit_scorer(docs, table(spark, sf_dir, "labels"), p))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))
