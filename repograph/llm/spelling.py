"""Spelling variants: the minimised acceptor of the vocabulary, composed with a one-edit transducer and the acceptor again, partition by partition.

Two words one edit apart, the shorter of n code points, agree in their first n // 2 or in their last n - n // 2 code points. So the acceptor is dealt into partitions by the state
after that prefix, and by the state before that suffix; each word goes to four at most: by prefix and suffix, for partners as long or longer and for shorter
ones. A partition's words differ in their middles only. Partitions of more than ``block`` words are split on the same rule in their middles, until
they are small or the middle is one code point, which an alphabet bounds; nothing is left out. A pair that fits both halves is taken where the prefix agrees.

In a partition the middles of each length are a minimal deterministic acceptor (built from sorted words, equal right languages merged). The composition's states are pairs of
acceptor states, before and after the edit: before it both sides read the same, then one side reads another code point (replaced) or the longer side reads one more
(inserted), after it both read the same again. Accepted paths are the near pairs; each is enumerated once, and counts and best partners are summed per word, so pairs
are never shuffled. Roots are found by doubling, in as many rounds as the logarithm of the longest chain of forms; a form occurs twice as often, so chains are short.

Edge cases: null texts have no runs and null doc_ids count as empty text in the checksum; repeated rows count again; very long runs are words like others; ties are broken by code-point
order; words without near words have no form and are their own root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class SpellingParams:
    shortest: int = 5
    least: int = 3
    times: int = 2  # how many times more often a form occurs than its variant
    noise: int = 97  # one run in so many loses a code point
    block: int = 4096


def vocabulary(docs: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text)."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(r"[a-zÀ-ÿ]+"), F.lit(0))
    told = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(runs).alias("run"))
    hashed = told.select("run", F.crc32(F.concat("id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % p.noise == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.char_length("word") >= p.shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= p.least)


class Acceptor:
    """A minimal deterministic acceptor of sorted distinct words; arcs are dicts, state 0 is the start."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        known: dict[tuple, int] = {}
        path: list[tuple[int, str, int]] = []  # arcs of the last word that aren't minimised yet
        last = ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._settle(path, same, known)
            state = path[-1][2] if path else 0
            for c in word[same:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[state][c] = new = len(self.arcs) - 1
                path.append((state, c, new))
                state = new
            self.final[state] = True
            last = word
        self._settle(path, 0, known)

    def _settle(self, path: list[tuple[int, str, int]], upto: int, known: dict[tuple, int]) -> None:
        while len(path) > upto:
            above, c, state = path.pop()
            language = (self.final[state], *self.arcs[state].items())
            self.arcs[above][c] = known.setdefault(language, state)


def composed_pairs(short: Acceptor, long: Acceptor | None) -> Iterator[tuple[str, str]]:
    """Pairs that short o (one replaced) o short accepts, the smaller first, and those of short o (one inserted) o long."""
    arcs, final = short.arcs, short.final
    todo = [(0, 0, "", "", False)]
    while todo:
        p, q, left, right, edited = todo.pop()
        if edited:
            if final[p] and final[q]:
                yield left, right
            other = arcs[q]
            for c, x in arcs[p].items():
                y = other.get(c)
                if y is not None:
                    todo.append((x, y, left + c, right + c, True))
            continue
        out = list(arcs[p].items())
        for i, (c, x) in enumerate(out):
            todo.append((x, x, left + c, left + c, False))
            for d, y in out[i + 1 :]:
                todo.append((x, y, left + c, left + d, True))
    if long is None:
        return
    more, ends = long.arcs, long.final
    todo = [(0, 0, "", "", False)]
    while todo:
        p, q, left, right, edited = todo.pop()
        if edited and final[p] and ends[q]:
            yield left, right
        other = more[q]
        for c, x in arcs[p].items():
            y = other.get(c)
            if y is not None:
                todo.append((x, y, left + c, right + c, edited))
        if not edited:
            for d, y in other.items():
                if not left or left[-1] != d:  # in a run of equal code points the first is the inserted one
                    todo.append((p, y, left, right + d, True))


def _partition_key() -> Column:
    length = F.char_length("word")
    return F.concat_ws("|", "n", "a", "b", "d", F.substring("word", F.lit(1), F.col("a")), F.substring("word", length - F.col("b") + 1, F.col("b")))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row by the first and by the last half of its middle: the fixed prefix a or the fixed suffix b grows; d > 0 asks that the first d code points differ."""
    r = F.col("n") - F.col("a") - F.col("b")
    first = F.struct((F.col("a") + F.floor(r / 2)).cast("int").alias("a"), F.col("b"), F.col("d"))
    second = F.struct(F.col("a"), (F.col("n") - F.col("a") - F.floor(r / 2)).cast("int").alias("b"), (F.col("a") + F.floor(r / 2)).cast("int").alias("d"))
    return rows.select("word", "count", "n", F.explode(F.array(first, second)).alias("x")).select("word", "count", "n", "x.*").withColumn("key", _partition_key())


def partitions(words: DataFrame, p: SpellingParams) -> DataFrame:
    """(key, word, count, n, a, b, d): the words of every partition that has a word of the shorter length and another."""
    length = F.char_length("word")
    roles = F.filter(F.array(length, length - 1), lambda n: n >= p.shortest)
    zero = F.lit(0).cast("int")
    rows = words.select("word", F.col("n").alias("count"), F.explode(roles).alias("n")).select("word", "count", F.col("n").cast("int").alias("n"), zero.alias("a"), zero.alias("b"), zero.alias("d"))
    rows = cut(_halves(rows))
    done = None
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("_size"), F.min(F.col("n") - F.col("a") - F.col("b")).alias("_middle"))
        large = cut(sizes.where((F.col("_size") > p.block) & (F.col("_middle") > 1)).select("key"))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = cut(_halves(rows.join(large, "key", "left_semi")))


def _tally(words: list[str], counts: list[int], n: int, a: int, b: int, d: int) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, count of the best, best) of one partition; words are sorted."""
    middles: tuple[dict, dict] = ({}, {})
    for w, c in zip(words, counts):
        middles[len(w) - n][w[a : len(w) - b]] = (w, c)
    short, long = middles
    if not short or len(short) + len(long) < 2:
        return
    near: dict[str, list] = {}

    def tell(word: str, other: str, count: int) -> None:
        own = near.get(word)
        if own is None:
            near[word] = [1, count, other]
        else:
            own[0] += 1
            if count > own[1] or count == own[1] and other < own[2]:
                own[1], own[2] = count, other

    for x, y in composed_pairs(Acceptor(sorted(short)), Acceptor(sorted(long)) if long else None):
        u, cu = short[x]
        v, cv = short[y] if len(x) == len(y) else long[y]
        if d and u[:d] == v[:d]:
            continue
        tell(u, v, cv)
        tell(v, u, cu)
    for w, (k, count, best) in near.items():
        yield w, k, count, best


def near_words(words: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """(word, n_near, best_n, best) of every word (word, n) that has near ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, held = None, []

        def done() -> None:
            if len(held) > 1:
                out.extend(_tally([r[1] for r in held], [r[2] for r in held], *held[0][3:]))

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != key:
                    done()
                    key, held = row[0], []
                held.append(row)
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])
            out.clear()
        done()
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])

    rows = partitions(words, p).select("key", "word", "count", "n", "a", "b", "d")
    dealt = rows.repartition(max(shuffle_partitions(words.sparkSession), 2), "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("_n"), F.col("best"))).alias("_b"))
    return best.select("word", "n_near", (-F.col("_b._n")).alias("best_n"), F.col("_b.best").alias("best"))


def chain_ends(links: DataFrame) -> DataFrame:
    """(word, root): where the chain of ``links`` (word, form) ends, by doubling: each round every word looks to where the word that it looks to did."""
    at = cut(links.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("_w"), F.col("root").alias("_to"))
        met = cut(at.join(step, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_more")))
        at = met.select("word", "root")
        if met.where("_more").isEmpty():
            return at


def spelling_variants(docs: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text)."""
    words = cut(vocabulary(docs, p))
    near = near_words(words, p)
    rows = cut(words.join(near, "word", "left"))
    own = F.coalesce(F.col("best_n") >= p.times * F.col("n"), F.lit(False))
    told = rows.select("word", F.when(own, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(own, F.col("best_n")).alias("form_n"))
    roots = chain_ends(told.where("form is not null").select("word", "form"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form, root and number of near words."""
    return spelling_variants(table(spark, sf_dir, "documents"))
