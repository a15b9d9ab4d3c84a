"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, banded and verified.

A document is the bag of its five-word shingles. The weight of a shingle is its count times 1 + ln((1 + N) / (1 + df)) / ln(1 + N), with
document frequencies over all documents, held for 2^17 classes of shingles (a fixed size; a shingle in more than about 0.5 % of the documents
stands out from its class). Identical texts are one class from the start. Each distinct text draws ``bands * rows`` improved
consistent weighted samples; texts that agree in all rows of a band share a bucket. Within a bucket pairs are compared by
their samples, and those that agree in at least ``agree`` of them are verified by weighted Jaccard similarity
over the whole bags. Only pairs that can still join two components are tried: first a maximum spanning forest and a star of each block of
a bucket, verified pair by pair; then, level by level, a few representatives of each component of a bucket that was dealt into blocks, so that the blocks of one group become one
component; last, cell by cell of a bucket, every row that is still outside the cell's largest component, against all rows there. So a group of
many copies costs about its size, pairs are never expanded, and no link between components is lost. Classes are the connected components of the verified links.

The chance that a pair of similarity 0.8 meets in no band or agrees in too few samples is below 1 % (0.4096 per band in
ten bands; 24 of 40), and falls fast above. Shingles are compared by 32-bit elements within a pair of texts.

Edge cases: null, empty and white-space-only texts have no shingles and form a class only with rows of the very same text when ``link_empty`` is set, else
each is alone; texts under five words have one shingle; a null doc_id takes part like any other and its class id is the least
doc_id of its class (null if there is none); repeated rows are exact copies; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, sweep, table, tidy
from .components import connected_components, joined_components
from .shingles import mix, occurrences, shingle_hashes, texts, word_hashes

CLASS_BITS = 17


@dataclass(frozen=True)
class NearParams:
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 10
    rows: int = 4
    agree: int = 24
    block: int = 1000  # rows of a bucket that are compared with each other in one piece
    speakers: int = 4  # rows that stand for a component where the pieces of a bucket are linked


def _bags(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted shingle hashes, bounds) of slices of a text column."""
    for at, data, offsets in texts(column):
        hashes, bounds = shingle_hashes(*word_hashes(data, offsets), k)
        yield at, hashes, bounds


def shingle_weights(docs: DataFrame, params: NearParams = NearParams()) -> np.ndarray:
    """Weight of each of the 2^17 shingle classes, from the document frequencies over all of ``docs`` (column text)."""
    n_classes, k = 1 << CLASS_BITS, params.shingle

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(n_classes, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, hashes, bounds in _bags(batch.column(0), k):
                own = (hashes >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
                new = np.ones(len(own), dtype=bool)
                new[1:] = own[1:] != own[:-1]
                new[bounds[:-1][bounds[:-1] < len(own)]] = True
                df += np.bincount(own[new], minlength=n_classes)
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], names=["class", "n"])

    rows = docs.select("text").mapInArrow(tidy(count), "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(n_classes + 1)
    df[rows["class"].to_numpy()] = rows["n"].to_numpy()
    n = max(df[-1], 1.0)
    return (1 + np.log((1 + n) / (1 + df[:-1])) / np.log(1 + n)).astype(np.float32)


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the gamma distribution with shape 2 at the middles of n equal steps, by Newton's method."""
    p = (np.arange(n) + 0.5) / n
    x = np.sqrt(2 * p) + p
    for _ in range(60):
        x = np.maximum(x - (1 - np.exp(-x) * (1 + x) - p) / np.maximum(x * np.exp(-x), 1e-12), 1e-6)
    return x


class Sampler:
    """Improved consistent weighted sampling; the random variables of a sample and an element come from a hash of both."""

    def __init__(self, samples: int):
        q = _gamma_quantiles()
        self.r, self.per_r, self.ln_c = q.astype(np.float32), (1 / q).astype(np.float32), np.log(q).astype(np.float32)
        seeds = mix(np.arange(1, 2 * samples + 1, dtype=np.uint64))
        self.times, self.plus = seeds[:samples, None] | np.uint64(1), seeds[samples:, None]

    def __call__(self, elements: np.ndarray, ln_weights: np.ndarray, chunk: int = 512) -> np.ndarray:
        """The 64-bit samples (element and level) of a non-empty weighted set."""
        best, sample = np.full(len(self.times), np.inf, dtype=np.float32), np.zeros(len(self.times), dtype=np.uint64)
        rows = np.arange(len(self.times))
        low = np.uint64(0xFFFF)
        for at in range(0, len(elements), chunk):
            e, s = elements[at : at + chunk], ln_weights[at : at + chunk]
            z = e[None, :] * self.times
            z += self.plus
            z ^= z >> np.uint64(29)
            z *= np.uint64(0xBF58476D1CE4E5B9)
            z ^= z >> np.uint64(32)
            first = (z & low).astype(np.intp)
            beta = ((z >> np.uint64(32)) & low).astype(np.float32) * np.float32(2**-16)
            level = np.floor(s[None, :] * self.per_r.take(first) + beta)
            ln_a = self.ln_c.take(((z >> np.uint64(16)) & low).astype(np.intp)) - self.r.take(first) * (level - beta + 1)
            k = ln_a.argmin(axis=1)
            a = ln_a[rows, k]
            better = a < best
            best[better] = a[better]
            sample[better] = mix(e[k[better]] + level[rows, k][better].astype(np.int64).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        return sample


def _key(text):
    """128-bit digest of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def signatures(docs: DataFrame, weights: np.ndarray, params: NearParams) -> DataFrame:
    """(doc_id, key, n_words, sig, bands) of every row: 8 bits of each sample, and the bucket of each band."""
    n, rows, k = params.bands * params.rows, params.rows, params.shingle
    shared = docs.sparkSession.sparkContext.broadcast(np.log(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, ln_w = Sampler(n), shared.value
        steps = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            sigs, bands = [], []
            for _, hashes, bounds in _bags(batch.column(2), k):
                elements = occurrences(hashes, bounds)
                ln = ln_w[(hashes >> np.uint64(64 - CLASS_BITS)).astype(np.int64)]
                for i in range(len(bounds) - 1):
                    b, e = bounds[i], bounds[i + 1]
                    if b == e:
                        sigs.append(b"")
                        bands.append([])
                        continue
                    sample = sampler(elements[b:e], ln[b:e])
                    sigs.append((sample >> np.uint64(56)).astype(np.uint8).tobytes())
                    band = (sample.reshape(params.bands, rows) * steps).sum(axis=1, dtype=np.uint64)
                    bands.append(mix(band + np.arange(params.bands, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)).view(np.int64))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "sig", "bands"]
            )

    return docs.select("doc_id", _key(F.col("text")).alias("key"), "text").mapInArrow(tidy(run), "doc_id long, key binary, sig binary, bands array<long>")


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``; many groups at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(key)[-1]
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cut_at = int(np.flatnonzero(values != last.as_py())[-1]) + 1 if values[0] != last.as_py() else 0
        if held and (cut_at or held[-1].column(key)[-1] != last):
            done = [*held, batch.slice(0, cut_at)] if cut_at else held
            yield pa.Table.from_batches(done)
            held = []
        elif cut_at:
            yield pa.Table.from_batches([batch.slice(0, cut_at)])
        if cut_at < batch.num_rows:
            held.append(batch.slice(cut_at))
    if held:
        yield pa.Table.from_batches(held)


def _forest(sig: np.ndarray, agree: int) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest over agreements of at least ``agree`` (Prim), and of a star around the row nearest to the column modes."""
    n = len(sig)
    if n == 2:
        return [(0, 1)] if (sig[0] == sig[1]).sum() >= agree else []
    modes = np.array([np.bincount(c).argmax() for c in sig.T], dtype=sig.dtype)
    hub = int((sig == modes).sum(axis=1).argmax())
    with_hub = (sig == sig[hub]).sum(axis=1)
    edges = {(min(hub, i), max(hub, i)) for i in np.flatnonzero(with_hub >= agree).tolist() if i != hub}
    best, near, done = with_hub.copy(), np.full(n, hub), np.zeros(n, dtype=bool)
    done[hub] = True
    best[hub] = -1
    for _ in range(n - 1):
        i = int(best.argmax())
        if best[i] >= agree:
            edges.add((min(i, int(near[i])), max(i, int(near[i]))))
        done[i] = True
        now = (sig == sig[i]).sum(axis=1)
        up = (now > best) & ~done
        best[up], near[up] = now[up], i
        best[i] = -1
    return sorted(edges)


def _by_cell(cells: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` with the rows of a cell together, in order of their key."""
    partitions = max(shuffle_partitions(cells.sparkSession), 2)
    return cells.select("cell", *columns).repartition(partitions, "cell").sortWithinPartitions("cell", "key")


def _spans(t: pa.Table) -> list[tuple[int, int]]:
    cell = t.column("cell").to_numpy()
    bounds = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]])).tolist()
    return [(s, e) for s, e in zip(bounds[:-1], bounds[1:]) if e - s > 1]


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(len(sigs), -1)


def _forest_pairs(cells: DataFrame, agree: int) -> DataFrame:
    """Pairs (a, b) of keys to verify first: the forest and star of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, "cell"):
            keys, sigs = t.column("key").to_pylist(), t.column("sig").to_pylist()
            a, b = [], []
            for s, e in _spans(t):
                for i, j in _forest(_matrix(sigs[s:e]), agree):
                    x, y = keys[s + i], keys[s + j]
                    if x != y:
                        a.append(max(x, y))
                        b.append(min(x, y))
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return _by_cell(cells, ["key", "sig"]).mapInArrow(tidy(run), "a binary, b binary")


def outside_rows(rows: DataFrame) -> DataFrame:
    """``rows`` (bucket, root, piece, pieces, ...) of the buckets that hold several components, with cell, outside and resident.

    Outside are the rows that aren't of the bucket's most frequent component. Each row stands in the cell of its own piece, an outside row in those of all
    others, too; so every pair of different components meets, and the copies are as few as there are outside rows.
    """
    sizes = rows.groupBy("bucket", "root").agg(F.count("*").alias("_n"))
    main = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("_n", "root")).alias("_main"), F.count("*").alias("_roots")).where("_roots > 1").drop("_roots")
    met = rows.join(main, "bucket").withColumn("outside", F.col("root") != F.col("_main"))
    place = F.when(F.col("outside"), F.expr("sequence(0, pieces - 1)")).otherwise(F.array("piece"))
    dealt = met.withColumn("_at", F.explode(place))
    return dealt.withColumn("resident", F.col("_at") == F.col("piece")).withColumn("cell", F.xxhash64("bucket", "_at")).drop("_at", "_main")


def _seen_before(sig: np.ndarray, i: int, band: int, rows: int) -> np.ndarray:
    """Rows whose samples equal those of row i in a whole band before ``band``; the pair is met there."""
    if not band:
        return np.zeros(len(sig), dtype=bool)
    return (sig[:, : band * rows] == sig[i, : band * rows]).reshape(len(sig), band, rows).all(axis=2).any(axis=1)


def _meets(t: pa.Table, s: int, e: int, own: np.ndarray, params: NearParams) -> Iterator[tuple[int, np.ndarray]]:
    """(row, residents of other components that agree with it and don't meet it in an earlier band) of the outside rows of one cell."""
    sig = _matrix(t.column("sig").slice(s, e - s).to_pylist())
    outside, resident = (t.column(c).slice(s, e - s).to_numpy() for c in ("outside", "resident"))
    band = t.column("band")[s].as_py()
    for i in np.flatnonzero(outside).tolist():
        met = ((sig == sig[i]).sum(axis=1) >= params.agree) & resident
        met &= (own != own[i]) & ~_seen_before(sig, i, band, params.rows)
        if resident[i]:
            met[:i] &= ~outside[:i]  # those have met row i already
        if met.any():
            yield i, met


def _components_of(roots: list) -> np.ndarray:
    names: dict = {}
    return np.array([names.setdefault(r, len(names)) for r in roots])


CELL = ["key", "root", "band", "outside", "resident", "sig"]


def _suspects(cells: DataFrame, params: NearParams) -> DataFrame:
    """The rows of cells that agree with a row of another component; as many as there are rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, "cell"):
            roots = t.column("root").to_pylist()
            hit = np.zeros(len(t), dtype=bool)
            for s, e in _spans(t):
                for i, met in _meets(t, s, e, _components_of(roots[s:e]), params):
                    hit[s:e] |= met
                    hit[s + i] = True
            yield from t.filter(pa.array(hit)).combine_chunks().to_batches()

    return _by_cell(cells, CELL).mapInArrow(tidy(run), "cell long, key binary, root binary, band int, outside boolean, resident boolean, sig binary")


def _cell_links(suspects: DataFrame, bags: DataFrame, weights: np.ndarray, params: NearParams) -> DataFrame:
    """Links (a, b) between components, found by comparing whole bags within each cell; each cell gives no more links than join its components."""
    shared = suspects.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        shift = np.uint32(32 - CLASS_BITS)
        for t in _grouped(batches, "cell"):
            keys, roots = t.column("key").to_pylist(), t.column("root").to_pylist()
            a, b = [], []
            for s, e in _spans(t):
                own = _components_of(roots[s:e])
                raw = t.column("bag").slice(s, e - s).to_pylist()
                sizes = np.array([len(x) // 4 for x in raw])
                names, at = np.unique(np.frombuffer(b"".join(raw), dtype="<u4"), return_inverse=True)
                weight, marked = w[names >> shift].astype(np.float64), np.zeros(len(names))
                ends = np.cumsum(sizes)
                starts = ends - sizes
                mass = np.add.reduceat(weight[at], starts)
                for i, met in _meets(t, s, e, own, params):
                    mine = at[starts[i] : ends[i]]
                    marked[mine] = weight[mine]
                    others = np.flatnonzero(met & (own != own[i]))
                    common = np.add.reduceat(marked[at], starts)[others] if 4 * len(others) > e - s else np.array([marked[at[starts[j] : ends[j]]].sum() for j in others.tolist()])
                    marked[mine] = 0
                    for j in others[common >= params.similarity * (mass[others] + mass[i] - common) - 1e-9].tolist():
                        if own[i] != own[j]:
                            own[own == own[j]] = own[i]
                            a.append(max(keys[s + i], keys[s + j]))
                            b.append(min(keys[s + i], keys[s + j]))
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return _by_cell(suspects.join(bags, "key"), [*CELL, "bag"]).mapInArrow(tidy(run), "a binary, b binary").distinct()


def _elements(docs: DataFrame, wanted: DataFrame, params: NearParams) -> DataFrame:
    """(key, bag): 32-bit elements of the texts of ``wanted`` (key, doc_id of one row that has the text)."""
    k = params.shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, hashes, bounds in _bags(batch.column(1), k):
                high = (hashes >> np.uint64(64 - CLASS_BITS)).astype(np.uint32) << np.uint32(32 - CLASS_BITS)
                own = high | (mix(occurrences(hashes, bounds)) & np.uint64((1 << (32 - CLASS_BITS)) - 1)).astype(np.uint32)
                out += [np.unique(own[b:e]).astype("<u4").tobytes() for b, e in zip(bounds[:-1], bounds[1:])]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["key", "bag"])

    read = docs.select("doc_id", _key(F.col("text")).alias("key"), "text").alias("d")
    met = read.join(wanted.alias("w"), (F.col("d.key") == F.col("w.key")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))
    return met.select("d.key", "d.text").mapInArrow(tidy(run), "key binary, bag binary").dropDuplicates(["key"])


def _verified(pairs: DataFrame, bags: DataFrame, weights: np.ndarray, similarity: float) -> DataFrame:
    """The pairs whose weighted Jaccard similarity is at least ``similarity``."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        shift = np.uint32(32 - CLASS_BITS)
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype="<u4"), np.frombuffer(y.as_buffer(), dtype="<u4")
                common = np.intersect1d(x, y, assume_unique=True)
                both = float(w[common >> shift].sum(dtype=np.float64))
                either = float(w[x >> shift].sum(dtype=np.float64) + w[y >> shift].sum(dtype=np.float64)) - both
                keep.append(both >= similarity * either - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = bags.select(F.col("key").alias("a"), F.col("bag").alias("bag_a"))
    two = bags.select(F.col("key").alias("b"), F.col("bag").alias("bag_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(tidy(run), "a binary, b binary")


def _buckets(distinct: DataFrame, block: int) -> DataFrame:
    """(key, doc_id, sig, band, bucket, size, piece, pieces): the texts (key, doc_id, sig, bands) in each of their buckets that others share.

    A bucket of more than ``block`` rows is dealt into pieces.
    """
    one = distinct.select("key", "doc_id", "sig", F.posexplode("bands").alias("band", "bucket"))
    sizes = one.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    pieces = F.ceil(F.col("size") / block).cast("int")
    return one.join(sizes, "bucket").withColumn("pieces", pieces).withColumn("piece", F.expr("cast(pmod(xxhash64(key, bucket), pieces) as int)"))


def _link_pieces(buckets: DataFrame, roots: DataFrame, bags: DataFrame, weights: np.ndarray, params: NearParams) -> DataFrame:
    """``roots`` after linking the pieces of large buckets: each component of a bucket sends a few rows, which meet as the rows of a bucket do; level by level while they fill several pieces themselves."""
    p, large = params, buckets.where("pieces > 1").select("bucket", "key", "sig")
    if large.isEmpty():
        return roots
    while True:
        named = large.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        nth = F.row_number().over(Window.partitionBy("bucket", "root").orderBy(F.xxhash64("key"), "key"))
        speakers = cut(named.withColumn("_nth", nth).where(F.col("_nth") <= p.speakers).select("bucket", "root", "key", "sig"))
        sizes = speakers.groupBy("bucket").agg(F.countDistinct("root").alias("_roots"), F.ceil(F.count("*") / p.block).cast("int").alias("_pieces")).where("_roots > 1")
        met = speakers.join(sizes, "bucket").withColumn("cell", F.xxhash64("bucket", F.expr("pmod(xxhash64(root, bucket), _pieces)")))
        # A row may speak in several buckets; its pairs are verified once.
        links = cut(_verified(_forest_pairs(met, p.agree).distinct(), bags, weights, p.similarity))
        roots = cut(joined_components(roots, links))
        several = sizes.agg(F.max("_pieces")).first()[0] or 1
        if several == 1 or links.isEmpty():
            return roots


def near_duplicate_classes(docs: DataFrame, params: NearParams = NearParams(), link_empty: bool = False) -> DataFrame:
    """(doc_id, key, class_key): one row per row of ``docs`` (columns doc_id, text); class_key is shared by a class."""
    p = params
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weights = shingle_weights(docs, p)
    signed = cut(signatures(docs, weights, p))
    distinct = signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    buckets = cut(_buckets(distinct, p.block))
    # First every text goes with its largest bucket alone, where most copies find each other.
    best = buckets.groupBy("key").agg(F.max(F.struct("size", "bucket", "piece")).alias("best"), F.first("doc_id").alias("doc_id"), F.first("sig").alias("sig"))
    bags = cut(_elements(docs, best.select("key", "doc_id"), p))
    cells = best.select(F.xxhash64("best.bucket", "best.piece").alias("cell"), "key", "sig")
    links = cut(_verified(_forest_pairs(cells, p.agree), bags, weights, p.similarity))
    roots = _link_pieces(buckets, cut(connected_components(links)), bags, weights, p)
    named = buckets.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    suspects = cut(_suspects(outside_rows(named), p))
    more = cut(_cell_links(suspects, bags, weights, p))
    roots = cut(joined_components(roots, more))
    sweep(docs.sparkSession)
    out = signed.select("doc_id", "key", F.length("sig").alias("_n")).join(roots.withColumnRenamed("node", "key"), "key", "left")
    alone = F.when(F.lit(link_empty) | (F.col("_n") > 0), F.col("key")).otherwise(F.encode(F.concat_ws(":", F.lit("empty"), F.col("doc_id").cast("string"), F.monotonically_increasing_id()), "utf-8"))
    return out.select("doc_id", "key", F.coalesce("root", alone).alias("class_key"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its class: class_id is the least doc_id of its near-duplicates, class_size their number."""
    found = cut(near_duplicate_classes(table(spark, sf_dir, "documents")))
    classes = found.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return found.join(classes, "class_key").select("doc_id", "class_id", "class_size")
