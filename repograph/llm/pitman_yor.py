"""Language model scores by a hierarchical Pitman-Yor model whose Chinese-restaurant seating is sampled by Gibbs.

Tokens are words in lower case A-Z and one end per document. A frequent word (one of ``frequent``) is a class of its own, the others are classed by their last two bytes
(``endings`` classes). There is a context restaurant for the class of the token before; all share a parent, the restaurant of
all classes, whose own parent is uniform; the words of an ending class are served by a restaurant of that class, whose parent is uniform over its words and an unknown one. So the class model gives
P(class | class before) and, for words that aren't frequent, P(word | class).

Below it every word that occurs has a restaurant of the words that follow it, however many there are: that of a word that isn't frequent serves all words, with the class model as its parent; a frequent word, whose classes are told
by its own context restaurant, has one for the words of each ending class, with P(word | class) as its parent. Only what follows a frequent word and is frequent itself needs none, as its class is the word. The class model seats every
token, not the tables of these restaurants, and is their parent as it is in the end. A text's probability is the product over its tokens.

Seating is described by the number of tables t of each dish, which is all that probabilities need. With a restaurant's total T of tables, a gamma variable
g of shape strength / discount + T makes the dishes independent: P(t) is then S(c, t) (discount g P0)^t, with the generalised Stirling number S of the seatings of c customers at t tables and the
parent's probability P0. So a sweep draws g given the tables, then the tables of all dishes given g, from the exact distribution (up to ``EXACT`` customers; beyond by its saddle point, at a cost that doesn't grow with c).
Tables are kept from sweep to sweep. Every table sends a customer to the parent, which is seated likewise; a context sees the parent as it was after the sweep before. In a class's restaurant words of equal counts are exchangeable,
so the chain runs over the histogram of counts. The predictive probabilities of the sweeps after ``burn`` are averaged, for class restaurants with the expected tables given g.

Pairs of words are counted like words: each block of texts sends its distinct pairs once, the task that has a context's pairs counts them, seats the context by the same sweeps and answers each block with the seated customers of
its pairs and the weight of the parent. For seating alone the parent's probability is rounded to a sixteenth of a decade; contexts are told apart by 48 bits, words within
a context by 40; seated customers are told to 0.04 %.

Every word of the corpus is counted, in one shuffle of the distinct words of blocks of texts: the task that has all blocks' rows of a range of word hashes adds them up and answers each
block with the totals. Texts are read again for the class counts and for scoring, in the same splits, so only word numbers travel. Words are told apart by a 64-bit hash.

Edge cases: null and empty texts are an end alone; null doc_ids count as the empty id for the folds; with no training rows N and V are 0 and every probability is the uniform parent's;
repeated rows are documents of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, partitions_for, shuffle_partitions, sweep, table
from .shingles import mix, range_hashes, texts, word_ranges

EXACT = 64  # customers of a dish up to which its tables are drawn from their exact distribution
DRAWN = 256  # words of one count and class that are drawn one by one in a sweep
END = np.uint64(mix(np.array([0x5EED], dtype=np.uint64))[0])
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class ModelParams:
    """discount and strength: of the contexts, the parent and the class restaurants; pair: those of the restaurants of the words after a word."""

    frequent: int = 1023
    endings: int = 512
    sweeps: int = 8
    burn: int = 3
    discounts: tuple = (0.7, 0.5, 0.8)
    strengths: tuple = (5.0, 10.0, 5.0)
    pair: tuple = (0.7, 2.0)
    seed: int = 11

    @property
    def classes(self) -> int:
        """The frequent words, the end, and the ending classes."""
        return self.frequent + 1 + self.endings


@dataclass
class Block:
    """Tokens of some texts: the number of each token in ``words`` (sorted hashes), and the first token of each text."""

    number: int
    first: int
    words: np.ndarray
    endings: np.ndarray
    tokens: np.ndarray
    bounds: np.ndarray


def _blocks(column: pa.Array, numbers: Iterator[int], endings: int) -> Iterator[Block]:
    for at, data, offsets in texts(column, 5 << 18):  # so that a block's words mostly have two-byte numbers
        starts, ends = word_ranges(data, offsets)
        hashes = range_hashes(data, (starts, ends))[0]
        n = len(offsets) - 1
        row = np.searchsorted(offsets, starts, side="right") - 1
        counts = np.bincount(row, minlength=n)
        bounds = np.concatenate([[0], np.cumsum(counts + 1)])
        every = np.full(bounds[-1], END, dtype=np.uint64)
        place = np.arange(len(starts)) + row
        every[place] = hashes
        last = _LOWER[data[ends - 1]] + 256 * np.where(ends - starts > 1, _LOWER[data[np.maximum(ends - 2, 0)]], 0)
        kind = np.zeros(bounds[-1], dtype=np.uint16)
        kind[place] = mix((last + 1).astype(np.uint64)) % np.uint64(endings)
        words, where, tokens = np.unique(every, return_index=True, return_inverse=True)
        yield Block(next(numbers), at, words, kind[where], tokens, bounds)


def _numbers() -> Iterator[int]:
    number = TaskContext.get().partitionId() << 32
    while True:
        yield number
        number += 1


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers in two, four or eight bytes each, with the width in the first byte."""
    width = 2 if not len(a) or a.max() < 1 << 16 else 4 if a.max() < 1 << 32 else 8
    return bytes([width]) + a.astype(f"<u{width}").tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=f"<u{b[0]}", offset=1).astype(np.int64)


def _planes(a: np.ndarray, first: int = 0, last: int = 8) -> bytes:
    """Bytes ``first`` to ``last`` of each 64-bit value, the lowest of all values before the next of all: high bytes of sorted values are nearly one run and compress away."""
    return np.ascontiguousarray(np.ascontiguousarray(a).astype("<u8").view(np.uint8).reshape(-1, 8)[:, first:last].T).tobytes()


def _unplaned(b: bytes, first: int = 0, last: int = 8) -> np.ndarray:
    wide = np.zeros((len(b) // (last - first), 8), dtype=np.uint8)
    wide[:, first:last] = np.frombuffer(b, dtype=np.uint8).reshape(last - first, -1).T
    return wide.view("<u8").ravel()


def _mark(words: np.ndarray) -> int:
    """A checksum by which two reads of a block are held against each other."""
    return int(np.bitwise_xor.reduce(words, initial=np.uint64(0)).view(np.int64))


def _word_totals(docs: DataFrame, params: ModelParams) -> DataFrame:
    """Rows of kind 0: (block, part, totals of the block's words in that part, word: their mark); 1: frequent words (hash, class, total); 2: (class, total, words of that total)."""
    partitions = partitions_for(docs)
    parts, p = np.uint64(2 * partitions), params

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers()
        for batch in batches:
            train = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for b in _blocks(batch.column(1), numbers, p.endings):
                learn = np.repeat(train[b.first : b.first + len(b.bounds) - 1], np.diff(b.bounds))
                counts = np.bincount(b.tokens, weights=learn, minlength=len(b.words)).astype(np.int64)
                part = ((b.words >> np.uint64(32)) * parts) >> np.uint64(32)
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
                rows = [(int(part[s]), b.number, _planes(b.words[s:e]), b.endings[s:e].tobytes(), _packed(counts[s:e])) for s, e in zip(cuts[:-1], cuts[1:])]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "block", "words", "endings", "counts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        if not rows:
            return
        words = np.concatenate([_unplaned(r[2]) for r in rows])
        unique, where, inverse = np.unique(words, return_index=True, return_inverse=True)
        totals = np.bincount(inverse, weights=np.concatenate([_unpacked(r[4]) for r in rows])).astype(np.int64)
        kinds = np.concatenate([np.frombuffer(r[3], dtype=np.uint16) for r in rows])[where]
        sizes = np.cumsum([0] + [len(r[2]) // 8 for r in rows])
        names = ["kind", "block", "part", "totals", "word", "class", "total", "distinct"]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        make = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for at in range(0, len(rows), 256):
            some = [(0, r[1], r[0], _packed(totals[inverse[b:e]]), _mark(words[b:e]), None, None, None) for r, b, e in zip(rows[at : at + 256], sizes[at:], sizes[at + 1 :])]
            yield make(some)
        top = np.argsort(-totals, kind="stable")[: p.frequent + 1]
        yield make([(1, None, None, None, int(unique[k : k + 1].view(np.int64)[0]), int(kinds[k]), int(totals[k]), None) for k in top.tolist() if totals[k]] or [(3,) + (None,) * 7])
        own = (unique != END) & (totals > 0)
        pairs, n = np.unique(np.stack([kinds[own].astype(np.int64), totals[own]], axis=1), axis=0, return_counts=True)
        if len(pairs):
            yield make([(2, None, None, None, None, k, c, m) for (k, c), m in zip(pairs.tolist(), n.tolist())])

    asked = docs.select("train", "text").mapInArrow(ask, "part long, block long, words binary, endings binary, counts binary")
    return asked.repartition(partitions, "part").mapInArrow(answer, "kind int, block long, part long, totals binary, word long, class int, total long, distinct long")


@lru_cache(maxsize=8)
def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of S(c, t), the summed weights of the seatings of c customers at t tables: S(c + 1, t) = (c - discount t) S(c, t) + S(c, t - 1)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, most):
            join = np.where(t <= c, out[c, 1:] + np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
            out[c + 1, 1:] = np.logaddexp(join, out[c, :-1])
    return out


def _saddle(c: np.ndarray, a: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(mean, variance) of the tables of many customers. The generating function of S is exp(a (1 - (1 - x)^discount) / discount), that of a Poisson number of tables."""

    def at(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Newton's method for y = ln(1 - x), from the right, where the concave function is below zero.
        level = np.log(c / a)
        y = np.minimum(-level / (1 - discount), -1e-12)
        for _ in range(30):
            rest = -np.expm1(y)
            y = np.minimum(y - (np.log(rest) + (discount - 1) * y - level) / (discount - 1 - np.exp(y) / rest), -1e-14)
        return a / discount * -np.expm1(discount * y), c + a * (1 - discount) * np.expm1(y) ** 2 * np.exp((discount - 2) * y)

    mean, spread = at(a)
    turn = -0.5 * (np.log(at(a * 1.0001)[1]) - np.log(spread)) / np.log(1.0001)  # how the saddle's width moves with a
    return mean + turn, np.maximum(mean - c * (c / spread), 0)


def _split(c: np.ndarray, a: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which dishes are drawn exactly, as one large table beside a Poisson number of others, and by the saddle point."""
    small = (c > 1) & (c <= EXACT)
    one = (c > EXACT) & (4 * (a / discount) ** (1 / discount) < c)
    return np.flatnonzero(small), np.flatnonzero(one), np.flatnonzero((c > EXACT) & ~one)


def _weights(c: np.ndarray, a: np.ndarray, discount: float) -> np.ndarray:
    """P(t), t = 1 to EXACT, of dishes of at most EXACT customers."""
    most = int(c.max())
    logs = log_stirling(discount)[c, 1 : most + 1] + np.arange(1, most + 1) * np.log(a)[:, None]
    w = np.exp(logs - logs.max(axis=1, keepdims=True))
    return w / w.sum(axis=1, keepdims=True)


def draw_tables(c: np.ndarray, a: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of independent dishes with ``c`` customers, drawn with P(t) in proportion to S(c, t) a^t."""
    t = np.minimum(c, 1).astype(np.float64)
    small, one, many = _split(c, a, discount)
    for at in range(0, len(small), 1 << 15):
        some = small[at : at + (1 << 15)]
        sums = _weights(c[some], a[some], discount).cumsum(axis=1)
        t[some] = np.minimum((sums < rng.random(len(some))[:, None]).sum(axis=1) + 1, c[some])
    t[one] = 1 + rng.poisson(a[one] / discount)
    mean, variance = _saddle(c[many], a[many], discount)
    t[many] = np.clip(np.rint(rng.normal(mean, np.sqrt(variance))), 1, c[many])
    return np.minimum(t, c)


def mean_tables(c: np.ndarray, a: np.ndarray, discount: float) -> np.ndarray:
    """The expected tables of the same dishes."""
    t = np.minimum(c, 1).astype(np.float64)
    small, one, many = _split(c, a, discount)
    for at in range(0, len(small), 1 << 15):
        some = small[at : at + (1 << 15)]
        w = _weights(c[some], a[some], discount)
        t[some] = w @ np.arange(1, w.shape[1] + 1)
    t[one] = np.minimum(1 + a[one] / discount, c[one])
    t[many] = np.clip(_saddle(c[many], a[many], discount)[0], 1, c[many])
    return t


def sweep_tables(c: np.ndarray, tables: np.ndarray, parent: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """One Gibbs sweep of a restaurant: the tables of each dish given those before, ``parent`` being the parent's probability of each dish."""
    if not tables.any():
        return tables
    g = rng.gamma(strength / discount + tables.sum())
    return draw_tables(c, np.maximum(discount * g * parent, 1e-300), discount, rng)


def count_grid() -> np.ndarray:
    """Counts at which expected tables are told: each up to EXACT, then doubling; what lies between is read off in logarithms."""
    return np.concatenate([np.arange(1, EXACT + 1), EXACT * 2 ** np.arange(1, 41)]).astype(np.int64)


def seat_classes(histogram: DataFrame, params: ModelParams) -> DataFrame:
    """(class, rest, means): per ending class the averaged weight of the parent and the expected tables at the counts of ``count_grid``; histogram: (class, total, n), the words of each count.

    A class's chain runs in one task, on as many rows as its words have different counts.
    """
    p = params
    d, s = p.discounts[2], p.strengths[2]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kind = int(rows["class"].iloc[0])
        rows = rows.sort_values("total")
        c, n = rows["total"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.int64)
        rng, parent = np.random.default_rng([p.seed, kind]), 1.0 / (n.sum() + 1)
        customers, tables, rest, gs, grid = (c * n).sum(), float(n.sum()), 0.0, 0, count_grid()
        means = np.zeros(len(grid))
        for sweep in range(p.sweeps):
            g = rng.gamma(s / d + tables)
            # Many words of one count are drawn one by one up to a bound, and beyond it as their sum's normal limit.
            few = np.minimum(n, DRAWN)
            drawn = draw_tables(np.repeat(c, few), np.full(few.sum(), d * g * parent), d, rng)
            owner = np.repeat(np.arange(len(c)), few)
            total = np.bincount(owner, weights=drawn, minlength=len(c))
            spread = np.maximum(np.bincount(owner, weights=drawn**2, minlength=len(c)) / few - (total / few) ** 2, 0)
            more = n - few
            tables, some = float(total.sum()), np.flatnonzero(more)
            if len(some):
                tables += float((more[some] * mean_tables(c[some], np.full(len(some), d * g * parent), d) + rng.normal(size=len(some)) * np.sqrt(more[some] * spread[some])).sum())
            if sweep >= p.burn:
                gs += 1
                rest += (s + d * tables) / (s + customers)
                means += mean_tables(grid, np.full(len(grid), d * g * parent), d)
        return pd.DataFrame({"class": [kind], "rest": [rest / gs], "means": [means / gs]})

    return histogram.groupBy("class").applyInPandas(run, "class int, rest double, means array<double>")


def _class_counts(docs: DataFrame, names: np.ndarray, kinds: np.ndarray, params: ModelParams) -> DataFrame:
    """(context, dishes, counts) of the training tokens, one row per context and task; ``names``: sorted hashes of the classes ``kinds``."""
    p, k = params, params.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, numbers = np.zeros(k * k, dtype=np.int64), _numbers()
        for batch in batches:
            train = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for b in _blocks(batch.column(1), numbers, p.endings):
                own = _classes(b, names, kinds, p)[b.tokens]
                learn = np.repeat(train[b.first : b.first + len(b.bounds) - 1], np.diff(b.bounds))
                total += np.bincount((_before(own, b, p) * k + own)[learn], minlength=k * k)
        total = total.reshape(k, k)
        some = np.flatnonzero(total.any(axis=1)).tolist()
        if some:
            dishes = [np.flatnonzero(total[u]) for u in some]
            yield pa.record_batch([pa.array(some, pa.int32()), pa.array([_packed(d) for d in dishes]), pa.array([_packed(total[u][d]) for u, d in zip(some, dishes)])], names=["context", "dishes", "counts"])

    return docs.select("train", "text").mapInArrow(run, "context int, dishes binary, counts binary")


def _classes(b: Block, names: np.ndarray, kinds: np.ndarray, p: ModelParams) -> np.ndarray:
    """The class of each word of a block."""
    out = b.endings.astype(np.int64) + p.frequent + 1
    at = np.minimum(np.searchsorted(names, b.words), len(names) - 1)
    hit = names[at] == b.words
    out[hit] = kinds[at[hit]]
    return out


def _before(own: np.ndarray, b: Block, p: ModelParams) -> np.ndarray:
    """The class of the token before each; before a text stands an end."""
    out = np.empty_like(own)
    out[1:] = own[:-1]
    out[b.bounds[:-1]] = p.frequent
    return out


def sample_contexts(counted: DataFrame, params: ModelParams) -> np.ndarray:
    """P(class | class before), averaged over sweeps: a table of ``classes`` squared numbers, whatever the corpus.

    Contexts are seated by Spark's tasks given the parent's distribution; the driver seats the parent, a row of ``classes`` numbers.
    """
    p, k = params, params.classes
    (d, d0, _), (s, s0, _) = p.discounts, p.strengths
    spark = counted.sparkSession

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            for u, dishes, counts in zip(*(c.to_pylist() for c in batch.columns)):
                rows.setdefault(u, np.zeros(k, dtype=np.int64))[_unpacked(dishes)] += _unpacked(counts)
        if rows:
            yield pa.record_batch([pa.array(list(rows), pa.int32()), pa.array([_packed(r) for r in rows.values()])], names=["context", "counts"])

    contexts = cut(counted.repartition(min(32, max(shuffle_partitions(spark), 2)), "context").mapInArrow(gather, "context int, counts binary"))
    state = contexts.withColumn("tables", F.lit(None).cast("binary"))
    parent, t0 = np.full(k, 1.0 / k), np.zeros(k)
    kept = np.zeros((k, k))
    for sweep in range(p.sweeps):
        given = spark.sparkContext.broadcast(parent)

        def run(batches: Iterator[pa.RecordBatch], sweep: int = sweep, given=given) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tables = []
                for u, counts, held in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    c = _unpacked(counts)
                    before = np.minimum(c, 1).astype(np.float64) if held is None else _unpacked(held).astype(np.float64)
                    tables.append(_packed(sweep_tables(c, before, given.value, d, s, np.random.default_rng([p.seed, sweep, u])).astype(np.int64)))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(tables, pa.binary())], names=["context", "counts", "tables"])

        state = cut(state.mapInArrow(run, "context int, counts binary, tables binary"))
        rows = [(r["context"], _unpacked(r["counts"]), _unpacked(r["tables"]).astype(np.float64)) for r in state.collect()]  # at most ``classes`` rows of a fixed size
        up = np.zeros(k)
        for _, _, t in rows:
            up += t
        t0 = np.minimum(np.maximum(t0, np.minimum(up, 1)), up)
        t0 = sweep_tables(up.astype(np.int64), t0, np.full(k, 1.0 / k), d0, s0, np.random.default_rng([p.seed, sweep, k]))
        parent = (np.maximum(up - d0 * t0, 0) + (s0 + d0 * t0.sum()) / k) / (s0 + up.sum())
        if sweep >= p.burn:
            fresh = np.tile(parent, (k, 1))  # a context never seen is its parent
            for u, c, t in rows:
                fresh[u] = (np.maximum(c - d * t, 0) + (s + d * t.sum()) * parent) / (s + c.sum())
            kept += fresh
    return (kept / max(p.sweeps - p.burn, 1)).astype(np.float64)


@dataclass
class Pairs:
    """The distinct pairs of a block that a word's restaurant serves, by context: ``at`` their tokens, ``which`` the pair of each of these; ``contexts`` with ``runs`` pairs each."""

    at: np.ndarray
    which: np.ndarray
    contexts: np.ndarray
    runs: np.ndarray
    words: np.ndarray
    parents: np.ndarray


_PAIR = np.uint64(0x9E3779B97F4A7C15)
_LOW, _HIGH = np.uint64((1 << 40) - 1), ~np.uint64((1 << 16) - 1)


def _pair_keys(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(contexts + mix(words) * _PAIR)


def _pairs(words: np.ndarray, tokens: np.ndarray, bounds: np.ndarray, seq: np.ndarray, before: np.ndarray, parent: np.ndarray, p: ModelParams) -> Pairs:
    """``words``: hashes of a block's words; ``parent``: log10 of the parent's probability of each token."""
    at = np.flatnonzero((before > p.frequent) | (seq > p.frequent))
    hashes = words[tokens]
    last = np.empty_like(hashes)
    last[1:] = hashes[:-1]
    last[bounds[:-1]] = END
    context, word = last[at], hashes[at] & _LOW
    split = before[at] <= p.frequent
    context = np.where(split, mix(context + (seq[at] + 1).astype(np.uint64) * _PAIR), context) & _HIGH
    _, where, which = np.unique(_pair_keys(context, word), return_index=True, return_inverse=True)
    order = np.lexsort((word[where], context[where]))  # by context, so that what is told of pairs is alike side by side
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    where = where[order]
    contexts, runs = np.unique(context[where], return_counts=True)
    return Pairs(at, place[which], contexts, runs, word[where], np.clip(np.rint(-16 * parent[at[where]]), 0, 255).astype(np.uint8))


def seat_pairs(context: np.ndarray, c: np.ndarray, parent: np.ndarray, params: ModelParams, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(seated customers of each pair, weight of the parent in each context, its customers), averaged over the sweeps; ``context``: the number of each pair's context, ``c`` its count, ``parent`` the parent's probability of it."""
    (d, s), p = params.pair, params
    n = int(context.max()) + 1 if len(context) else 0
    customers = np.bincount(context, weights=c, minlength=n)
    fixed = np.bincount(context[c == 1], minlength=n).astype(np.float64)  # one customer has one table
    many = np.flatnonzero(c > 1)
    many = many[np.argsort(c[many], kind="stable")]  # so that what is drawn together has like counts
    owner, count, mass = context[many], c[many], parent[many]
    tables, rest, means, sweeps = np.ones(len(many)), np.zeros(n), np.zeros(len(many)), 0
    for sweep in range(p.sweeps):
        g = rng.gamma(s / d + fixed + np.bincount(owner, weights=tables, minlength=n))
        a = np.maximum(d * g[owner] * mass, 1e-300)
        tables = draw_tables(count, a, d, rng)
        if sweep >= p.burn:
            sweeps += 1
            rest += (s + d * (fixed + np.bincount(owner, weights=tables, minlength=n))) / (s + customers)
            means += tables
    seated = np.where(c == 1, 1 - d, 0.0)
    seated[many] = np.maximum(count - d * means / max(sweeps, 1), 0)
    return seated, rest / max(sweeps, 1), customers


def _coded(x: np.ndarray) -> np.ndarray:
    """Zero or numbers over 1/256 as 16 bits, in logarithmic steps."""
    return np.where(x > 0, 1 + np.rint((np.log2(np.maximum(x, 2**-8)) + 8) * 1024), 0).astype("<u2")


def _decoded(b: bytes) -> np.ndarray:
    code = np.frombuffer(b, dtype="<u2").astype(np.float64)
    return np.where(code > 0, 2.0 ** ((code - 1) / 1024 - 8), 0.0)


def _seated(asked: DataFrame, partitions: int, params: ModelParams) -> DataFrame:
    """(block, part, seated, rest, customers): per block the seated customers of its pairs, and the parent's weight and the customers of its contexts."""

    def seat(rows: list[tuple]) -> pa.RecordBatch:
        contexts = [_unplaned(r[2], 2, 8) for r in rows]
        runs = [_unpacked(r[3]) for r in rows]
        context = np.concatenate([np.repeat(u, k) for u, k in zip(contexts, runs)])
        word = np.concatenate([_unplaned(r[4], 0, 5) for r in rows])
        _, where, which = np.unique(_pair_keys(context, word), return_index=True, return_inverse=True)
        c = np.bincount(which, weights=np.concatenate([_unpacked(r[5]) for r in rows])).astype(np.int64)
        parent = 10.0 ** (np.frombuffer(b"".join(r[6] for r in rows), dtype=np.uint8)[where] / -16.0)
        names, number = np.unique(context[where], return_inverse=True)
        # Pairs stand in order of their keys and draws follow the part, whatever the order in which rows came.
        seated, rest, customers = seat_pairs(number, c, parent, params, np.random.default_rng([params.seed, rows[0][0]]))
        seated, rest, customers = _coded(seated)[which], rest.astype("<f4"), customers.astype(np.int64)
        ends = np.cumsum([0] + [int(k.sum()) for k in runs])
        own = [np.searchsorted(names, u) for u in contexts]
        out = [(r[1], r[0], seated[b:e].tobytes(), rest[u].tobytes(), _packed(customers[u])) for r, u, b, e in zip(rows, own, ends, ends[1:])]
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), *(pa.binary(),) * 3))], names=["block", "part", "seated", "rest", "customers"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    yield seat(held)
                    held = []
                held.append(row)
        if held:
            yield seat(held)

    return asked.repartition(partitions, "part").sortWithinPartitions("part", "block").mapInArrow(answer, "block long, part long, seated binary, rest binary, customers binary")


def language_model_scores(docs: DataFrame, train, params: ModelParams = ModelParams()) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text); ``train``: Column that is true where a row is learnt from."""
    p, spark = params, docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("train"))
    answers = cut(_word_totals(rows, p))
    top = answers.where("kind = 1").select("word", "class", "total").orderBy(F.desc("total"), "word").limit(p.frequent + 1).toPandas()
    histogram = answers.where("kind = 2").groupBy("class", "total").agg(F.sum("distinct").alias("n"))
    end = np.array([END]).view(np.int64)[0]
    ends = top[top["word"] == end]["total"].sum()
    if not ends:
        ends = answers.where((F.col("kind") == 1) & (F.col("word") == int(end))).agg(F.sum("total")).first()[0] or 0
    top = top[top["word"] != end].head(p.frequent)
    known = histogram.agg(F.sum(F.col("total") * F.col("n")), F.sum("n")).first()
    n_all, v_all = int((known[0] or 0) + ends), int((known[1] or 0) + (ends > 0))
    names, kinds = np.append(top["word"].to_numpy(dtype=np.int64), end).view(np.uint64), np.append(np.arange(len(top)), p.frequent)
    order = np.argsort(names)
    names, kinds = names[order], kinds[order]
    table_of = spark.sparkContext.broadcast(np.log10(np.maximum(sample_contexts(_class_counts(rows, names, kinds, p), p), 1e-300)).astype(np.float32))
    # The frequent words are no dishes of their ending class.
    taken = spark.createDataFrame(top[["class", "total"]].astype("int64").value_counts().reset_index(name="m"), "class int, total long, m long")
    histogram = cut(histogram.join(F.broadcast(taken), ["class", "total"], "left").select("class", "total", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).where("n > 0"))
    d, s = p.discounts[2], p.strengths[2]
    c, v = np.zeros(p.endings), np.zeros(p.endings)
    for r in histogram.groupBy("class").agg(F.sum(F.col("total") * F.col("n")).alias("c"), F.sum("n").alias("v")).collect():
        c[r["class"]], v[r["class"]] = r["c"], r["v"]
    grid = np.log(count_grid())
    rest, means = np.ones(p.endings), np.ones((p.endings, len(grid)))  # one row per ending class, of a fixed size
    for r in seat_classes(histogram, p).collect():
        rest[r["class"]], means[r["class"]] = r["rest"], r["means"]
    rest = rest / (v + 1)
    seats = spark.sparkContext.broadcast(np.log(means))

    def tables_of(count: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Averaged tables of the words of ending classes."""
        at = np.log(np.maximum(count, 1))
        k = np.clip(np.searchsorted(grid, at, side="right") - 1, 0, len(grid) - 2)
        part = (at - grid[k]) / (grid[k + 1] - grid[k])
        return np.exp((1 - part) * seats.value[e, k] + part * seats.value[e, k + 1])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers()
        for batch in batches:
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for b in _blocks(batch.column(1), numbers, p.endings):
                n = len(b.bounds) - 1
                row = (b.number, batch.column(0).slice(b.first, n).to_pylist(), train[b.first : b.first + n].tobytes(), _planes(b.words), _classes(b, names, kinds, p).astype("<u2").tobytes(), _packed(b.tokens), _packed(b.bounds), _mark(b.words))
                yield pa.record_batch([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.list_(pa.int64()), *(pa.binary(),) * 5, pa.int64()))], names=["block", "ids", "train", "words", "classes", "tokens", "bounds", "mark"])

    def read(row: tuple) -> tuple:
        """(count of each word, tokens, bounds, class of each token, class before, log10 P(class | class before), log10 P(word | class), pairs) of a block."""
        words, classes, tokens, bounds, mark, totals, told = row
        words, own, tokens, bounds = _unplaned(words), np.frombuffer(classes, dtype="<u2").astype(np.int64), _unpacked(tokens), _unpacked(bounds)
        count = np.concatenate([_unpacked(t["totals"]) for t in sorted(totals, key=lambda t: t["part"])])
        if len(count) != len(own) or mark != told:
            raise ValueError("a block of texts differs between two reads of the documents")
        ending = own - (p.frequent + 1)
        rare = ending >= 0
        e = np.where(rare, ending, 0)
        word = np.where(rare, np.log10(np.maximum(count - d * tables_of(count, e), 0) / (s + c[e]) + rest[e]), 0.0)[tokens]
        seq = own[tokens]
        before = np.empty_like(seq)
        before[1:] = seq[:-1]
        before[bounds[:-1]] = p.frequent
        kind = table_of.value[before, seq].astype(np.float64)
        return count, tokens, bounds, before, kind, word, _pairs(words, tokens, bounds, seq, before, np.where(before > p.frequent, kind + word, word), p)

    sweep(spark)
    partitions = partitions_for(rows)
    parts = np.uint64(4 * partitions)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, train, *row in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7, 8, 9))):
                _, _, bounds, _, _, _, b = read(row)
                learn = np.repeat(np.frombuffer(train, dtype=bool), np.diff(bounds))[b.at]
                counts = np.bincount(b.which, weights=learn, minlength=len(b.words)).astype(np.int64)
                part = ((b.contexts >> np.uint64(32)) * parts) >> np.uint64(32)
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist() if len(part) else [0]
                ends = np.concatenate([[0], np.cumsum(b.runs)])
                out = [(int(part[f]), block, _planes(b.contexts[f:t], 2, 8), _packed(b.runs[f:t]), _planes(b.words[ends[f] : ends[t]], 0, 5), _packed(counts[ends[f] : ends[t]]), b.parents[ends[f] : ends[t]].tobytes()) for f, t in zip(cuts[:-1], cuts[1:])]
                if out:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), *(pa.binary(),) * 5))], names=["part", "block", "contexts", "runs", "words", "counts", "parents"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, *row, seated in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4, 5, 6, 7, 8, 9, 10))):
                count, tokens, bounds, before, kind, word, b = read(row)
                base = np.log10((count + 1) / (n_all + v_all + 1))
                seated = sorted(seated or [], key=lambda t: t["part"])
                share = _decoded(b"".join(t["seated"] for t in seated))
                weight = np.repeat(np.frombuffer(b"".join(t["rest"] for t in seated), dtype="<f4").astype(np.float64), b.runs)
                if len(share) != len(b.words):
                    raise ValueError("a block's pairs were not all answered")
                if seated:
                    share /= p.pair[1] + np.repeat(np.concatenate([_unpacked(t["customers"]) for t in seated]), b.runs)
                every, own = kind + word, before[b.at] > p.frequent
                parent = np.where(own, every[b.at], word[b.at])
                every[b.at] = np.where(own, 0.0, kind[b.at]) + np.log10(share[b.which] + weight[b.which] * 10.0**parent)
                add = lambda x: np.add.reduceat(x, bounds[:-1])
                sizes = np.diff(bounds)
                yield pa.record_batch(
                    [pa.array(ids, pa.int64()), pa.array(sizes), pa.array(add((count > 0)[tokens].astype(np.int64))), pa.array(np.full(len(sizes), n_all)), pa.array(add(base[tokens])), pa.array(add(every))],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    numbered = rows.select("doc_id", "text", "train").mapInArrow(number, "block long, ids array<long>, train binary, words binary, classes binary, tokens binary, bounds binary, mark long")
    told = answers.where("kind = 0").groupBy("block").agg(F.collect_list(F.struct("part", "totals")).alias("totals"), F.bit_xor("word").alias("told"))  # as many parts as partitions, of one block
    joined = numbered.join(told, "block").select("block", "ids", "train", "words", "classes", "tokens", "bounds", "mark", "totals", "told")
    asked = joined.mapInArrow(ask, "part long, block long, contexts binary, runs binary, words binary, counts binary, parents binary")
    seated = _seated(asked, partitions, p).groupBy("block").agg(F.collect_list(F.struct("part", "seated", "rest", "customers")).alias("answers"))
    return joined.join(seated, "block", "left").select(*joined.columns, "answers").mapInArrow(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the model learnt from those whose crc32 remainder by seven isn't 2."""
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    docs = table(spark, sf_dir, "documents")
    scored = language_model_scores(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
