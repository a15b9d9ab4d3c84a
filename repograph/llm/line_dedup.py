"""Duplicate and near-duplicate lines by a segment-partition edit join.

Every line with a word takes part. Equal lines are one class from the start. Two different lines are linked when their edit distance is at most ``edits`` and at most one for
every ``each`` code points of the longer line, a similarity of 0.8: short words that differ in a letter or two stay apart. Lines below ``min_chars`` code points, which can't reach that, are only compared for equality.
A line of length l is cut into edits + 1 even segments, so a line within reach holds one of
them unchanged, at a place that its length and the segment's number confine to a few offsets. Every line emits hashes of its own segments (index rows)
and of the substrings at those offsets for its own length and the ``edits`` lengths below (probe rows); rows that meet are candidates, and candidates are
verified by banded bit-parallel edit distance on what is left between their common prefix and suffix. The classes are the connected components of the links; the first line
(least doc_id, then line number) of a class stays.

One pass over the texts gives line rows (hashes and places), another segment rows of 16 bytes, which travel as blocks of packed arrays. Only lines that meet in a segment get
their text. Where many lines meet, pairs are not expanded: a bucket is dealt into pieces, and within a piece the lines are held against one of them, then those outside the largest
component against the rest. Over the pieces of a large bucket only lines outside the bucket's main component visit the other pieces. A cell gives only the links that join
components, so none between components is lost.

Edge cases: null or empty text and lines of white space alone have no lines that take part; a null doc_id counts as the last; rows that repeat both doc_id and text keep and lose the same lines;
rows that share only the doc_id are told apart by a hash of the text; text without duplicates is returned unchanged; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions_for, table, tidy
from .components import connected_components, joined_components
from .near_dedup import _grouped, _spans, outside_rows
from .shingles import BASE, _power_tables, _SPACE, mix, texts


@dataclass(frozen=True)
class LineParams:
    """``edits`` at most, and one for every ``each`` code points of the longer line: 5 is a similarity of 0.8."""

    edits: int = 2
    each: int = 5
    min_words: int = 1
    block: int = 1000

    @property
    def min_chars(self) -> int:
        """The least length of a line that may be linked: it has edits + 1 non-empty segments, and one edit more gives ``each`` code points."""
        return max(self.edits + 1, self.each - 1)


SHORT = 256  # code points up to which lines are compared many at a time
_BYTE_1 = mix(np.arange(1, 257, dtype=np.uint64))
_BYTE_2 = mix(np.arange(1001, 1257, dtype=np.uint64))


def _lines(data: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """(text, line number, first byte, end byte) of the lines of at least ``min_words`` words."""
    n = len(data)
    feeds = np.flatnonzero(data == 10)
    feed_doc = np.searchsorted(offsets, feeds, side="right") - 1
    docs = len(offsets) - 1
    starts = np.concatenate([offsets[:-1], feeds + 1])
    doc = np.concatenate([np.arange(docs), feed_doc])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.empty_like(starts)
    ends[:-1] = np.where(doc[1:] == doc[:-1], starts[1:] - 1, offsets[doc[:-1] + 1])
    if len(ends):
        ends[-1] = n
    first = np.searchsorted(doc, np.arange(docs))
    number = np.arange(len(doc)) - first[doc]
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = offsets[1:-1][offsets[1:-1] < n]
    begins[inner] = ~space[inner]
    at = np.flatnonzero(begins)
    words = np.searchsorted(at, ends) - np.searchsorted(at, starts)
    keep = words >= min_words
    return doc[keep], number[keep], starts[keep], ends[keep]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each byte range."""
    up, down = _power_tables(len(data))
    out = []
    for values in (_BYTE_1, _BYTE_2):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=sums[1:])
        out.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return out[0], out[1]


def _code_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slice's code points and the ranges in them; bytes stand for themselves where it isn't valid UTF-8."""
    try:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    except UnicodeDecodeError:
        return data.astype(np.uint32), starts, ends
    if len(points) == len(data):
        return points, starts, ends
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return points, before[starts], before[ends]


def segments(length: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, size) of the edits + 1 even segments of lines of the given lengths, one column per segment; the last ones take the rest."""
    k = edits + 1
    short, longer = length // k, length % k
    sizes = np.stack([short + (i >= k - longer) for i in range(k)], axis=1)
    return np.cumsum(sizes, axis=1) - sizes, sizes


def _keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(line, hash, is index row): index rows of every line, and its probes of its own length and the ``edits`` lengths below.

    A probe of its own length at a segment's own place equals the line's index row and isn't emitted. For a line of length l + d the
    substring for segment i may lie off by up to i (of what is left before it) and, seen from the right, by edits - i around d.
    """
    up, down = _power_tables(len(points) + 1)
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(7)) * up[: len(points)], out=sums[1:])
    size = ends - starts
    place = np.arange(len(starts))

    def hashed(at: np.ndarray, n: np.ndarray, base: np.ndarray, i: int) -> np.ndarray:
        return mix((sums[at + n] - sums[at]) * down[at] + (base * (edits + 1) + i).astype(np.uint64) * BASE)

    for d in range(edits + 1):
        base = size - d  # the length of the indexed line
        first, sizes = segments(base, edits)
        for i in range(edits + 1):
            lo, hi = max(-i, d - (edits - i)), min(i, d + (edits - i))
            for shift in range(lo, hi + 1):
                at = first[:, i] + shift
                ok = (at >= 0) & (at + sizes[:, i] <= size) & (sizes[:, i] > 0)
                index = d == 0 and shift == 0
                yield place[ok], hashed(starts[ok] + at[ok], sizes[ok, i], base[ok], i), index


def _line_rows(docs: DataFrame, params: LineParams, names: list[str]) -> DataFrame:
    """(*names, line_no, ref, key): every line that takes part."""
    p = params
    given = docs.select(*names, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in texts(batch.column(len(names))):
                doc, number, starts, ends = _lines(data, offsets, p.min_words)
                if not len(starts):
                    continue
                ref, key = _hashes(data, starts, ends)
                ref &= ~np.uint64(1)
                own = pa.array(doc + at)
                yield pa.record_batch(
                    [*[batch.column(i).take(own) for i in range(len(names))], pa.array(number.astype(np.int32)), pa.array(ref.view(np.int64)), pa.array(key.view(np.int64))],
                    names=[*names, "line_no", "ref", "key"],
                )

    return given.mapInArrow(tidy(run), f"{schema}, line_no int, ref long, key long")


def _segment_blocks(docs: DataFrame, params: LineParams, parts: int) -> DataFrame:
    """(part, block): packed (hash, line reference with the index flag in its lowest bit) pairs of one range of hashes.

    They go from the scan straight into the shuffle by part, so that they lie on disk once.
    """
    p = params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal n
            key = np.concatenate(hashes)
            part = (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.uint16 if parts < 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            rows = np.stack([key[order], np.concatenate(marks)[order]], axis=1)
            part = part[order]
            bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            hashes.clear(), marks.clear()
            n = 0
            blocks = [rows[b:e].tobytes() for b, e in zip(bounds[:-1], bounds[1:])]
            return pa.record_batch([pa.array(part[bounds[:-1]].astype(np.int64)), pa.array(blocks, pa.binary())], names=["part", "block"])

        for batch in batches:
            for _, data, offsets in texts(batch.column(0)):
                _, _, starts, ends = _lines(data, offsets, p.min_words)
                if not len(starts):
                    continue
                ref, once = np.unique(_hashes(data, starts, ends)[0] & ~np.uint64(1), return_index=True)
                points, s, e = _code_points(data, starts[once], ends[once])
                long = e - s >= p.min_chars
                ref = ref[long]
                for line, h, index in _keys(points, s[long], e[long], p.edits):
                    hashes.append(h)
                    marks.append(ref[line] | np.uint64(index))
                    n += len(h)
                if n >= 2_000_000:
                    yield flush()
        if n:
            yield flush()

    return docs.select("text").mapInArrow(tidy(run), "part long, block binary")


def _meetings(blocks: DataFrame, partitions: int, block: int) -> DataFrame:
    """(bucket, ref, indexed, piece, pieces): the lines that meet in a segment, where at least one is indexed; a bucket is dealt into pieces of ``block`` lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x.as_buffer(), dtype=np.uint64).reshape(-1, 2) for batch in batches for x in batch.column(1)]
        if not held:
            return
        key, mark = np.concatenate([h[:, 0] for h in held]), np.concatenate([h[:, 1] for h in held])
        held.clear()
        order = np.argsort(key)
        key, mark = key[order], mark[order]
        same = key[1:] == key[:-1]
        some = np.zeros(len(key), dtype=bool)
        some[1:] |= same
        some[:-1] |= same
        key, mark = key[some], mark[some]
        order = np.lexsort((mark, key))
        key, mark = key[order], mark[order]
        if not len(key):
            return
        ref, index = mark & ~np.uint64(1), mark & np.uint64(1)
        first = np.ones(len(key), dtype=bool)
        first[1:] = (key[1:] != key[:-1]) | (ref[1:] != ref[:-1])
        at = np.flatnonzero(first)
        indexed = np.maximum.reduceat(index, at)
        bucket, ref = key[at], ref[at]
        group = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        counts = np.diff(np.append(group, len(bucket)))
        good = np.repeat((counts > 1) & (np.maximum.reduceat(indexed, group) > 0), counts)
        if good.any():
            piece = (np.arange(len(bucket)) - np.repeat(group, counts)) // block
            pieces = np.repeat(-(-counts // block), counts)
            yield pa.record_batch(
                [pa.array(bucket[good].view(np.int64)), pa.array(ref[good].view(np.int64)), pa.array(indexed[good] > 0), pa.array(piece[good].astype(np.int32)), pa.array(pieces[good].astype(np.int32))],
                names=["bucket", "ref", "indexed", "piece", "pieces"],
            )

    return blocks.repartition(partitions, "part").mapInArrow(tidy(run), "bucket long, ref long, indexed boolean, piece int, pieces int")


def within(pairs: list[tuple[np.ndarray, np.ndarray]], edits: int) -> np.ndarray:
    """Whether each pair of code point arrays has an edit distance of at most ``edits``.

    Bit-parallel columns over a band around the diagonal, many pairs at a time: bit b of a word stands for row column + edits - (width - 1) + b of the longer string.
    """
    verdict = np.zeros(len(pairs), dtype=bool)
    work = []
    for i, (a, b) in enumerate(pairs):
        if len(a) < len(b):
            a, b = b, a
        if len(a) - len(b) > edits:
            continue
        n = len(b)
        off = a[:n] != b
        head = int(off.argmax()) if off.any() else n
        a, b = a[head:], b[head:]
        n = len(b)
        off = a[len(a) - n :][::-1] != b[::-1]
        tail = int(off.argmax()) if n and off.any() else n
        a, b = a[: len(a) - tail], b[: n - tail]
        if len(b) == 0 or len(a) <= edits:
            verdict[i] = len(a) <= edits
        else:
            work.append((len(a), i, a, b))
    work.sort(key=lambda x: x[0])
    at = 0
    while at < len(work):
        to = at + 1
        while to < len(work) and (to - at) * work[to][0] < 2_000_000:
            to += 1
        some = work[at:to]
        d = _banded([w[2] for w in some], [w[3] for w in some], edits)
        verdict[[w[1] for w in some]] = d <= edits
        at = to
    return verdict


def _banded(one: list[np.ndarray], two: list[np.ndarray], edits: int) -> np.ndarray:
    """Edit distances up to ``edits`` (more: edits + 1) of longer strings ``one`` to ``two``."""
    pad, n = 2 * edits + 4, len(one)
    m1, m2 = np.array([len(x) for x in one]), np.array([len(x) for x in two])
    most = int(m2.max())
    a = np.full((most + edits + 2 * pad, n), 0xFFFFFFFF, dtype=np.uint32)  # rows of the longer string, shifted by pad
    b = np.full((most, n), 0xFFFFFFFE, dtype=np.uint32)
    for i in range(n):
        a[pad : pad + m1[i], i] = one[i]
        b[: m2[i], i] = two[i]
    return _bands(a, b, m1, m2, edits)


def _bands(a: np.ndarray, b: np.ndarray, m1: np.ndarray, m2: np.ndarray, edits: int) -> np.ndarray:
    """The same of padded code points, one column per pair; m1 and m2: lengths of the longer and the shorter strings."""
    width = pad = 2 * edits + 4
    n, most = a.shape[1], len(b)
    word, top = np.uint64((1 << width) - 1), np.uint64(width - 1)
    one_bit = np.uint64(1)
    vp = np.full(n, ((1 << (edits + 1)) - 1) << (width - 1 - edits), dtype=np.uint64)
    vn = np.zeros(n, dtype=np.uint64)
    dist = np.full(n, edits, dtype=np.int64)
    last = np.full(n, width - 2, dtype=np.int64)  # the bit of the last row, once the band has reached it
    flats = edits - (m1 - m2)  # steps by which the last row's distance can fall again
    out, rows = np.full(n, edits + 1, dtype=np.int64), np.arange(n)
    for j in range(most):
        if j % 16 == 15:
            on = (dist - flats <= edits) & (j < m2)
            done = j >= m2
            out[rows[done]] = dist[done]
            if not on.all():
                a, b = a[:, on], b[:, on]
                rows, m1, m2, flats, vp, vn, dist, last = (x[on] for x in (rows, m1, m2, flats, vp, vn, dist, last))
                n = len(rows)
                if not n:
                    break
        eq = np.zeros(n, dtype=np.uint64)
        for bit in range(width):
            eq |= (a[pad + j + edits - (width - 1) + bit] == b[j]).astype(np.uint64) << np.uint64(bit)
        live = j < m2
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & word
        hp = (vn | ~(d0 | vp)) & word
        hn = d0 & vp
        diagonal = live & (j < m1 - edits)
        flat = live & ~diagonal
        dist += diagonal & ((d0 >> top) & one_bit == 0)
        shift = np.maximum(last, 0).astype(np.uint64)
        dist += flat * (((hp >> shift) & one_bit).astype(np.int64) - ((hn >> shift) & one_bit).astype(np.int64))
        last -= flat
        vp = (hn | ~((d0 >> one_bit) | hp)) & word
        vn = (d0 >> one_bit) & hp
    out[rows] = dist
    return np.minimum(out, edits + 1)


def _texts_of(docs: DataFrame, params: LineParams) -> DataFrame:
    """(ref, line): the lines long enough for the join, each once per slice of a batch."""
    p = params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in texts(batch.column(0)):
                _, _, starts, ends = _lines(data, offsets, p.min_words)
                long = ends - starts >= p.min_chars
                starts, ends = starts[long], ends[long]
                if not len(starts):
                    continue
                ref, _ = _hashes(data, starts, ends)
                ref, once = np.unique(ref & ~np.uint64(1), return_index=True)
                starts, ends = starts[once], ends[once]
                # Arrow takes the lines out of one array of the whole slice, cut at the starts and ends.
                order = np.argsort(starts)
                cuts = np.stack([starts[order], ends[order]], axis=1).ravel().astype(np.int32)
                pieces = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data)])
                yield pa.record_batch([pa.array(ref[order].view(np.int64)), pieces.take(pa.array(np.arange(0, len(cuts), 2)))], names=["ref", "line"])

    return docs.select("text").mapInArrow(tidy(run), "ref long, line binary")


def _points(line: bytes) -> np.ndarray:
    try:
        return np.frombuffer(line.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    except UnicodeDecodeError:
        return np.frombuffer(line, dtype=np.uint8).astype(np.uint32)


def _sketch(points: list[np.ndarray]) -> np.ndarray:
    """Counts of the code points of each line by their value modulo 32, modulo 256; an edit changes them by two in sum at most."""
    row = np.repeat(np.arange(len(points)), [len(x) for x in points])
    flat = np.concatenate(points).astype(np.int64) & 31
    return np.bincount(row * 32 + flat, minlength=32 * len(points)).reshape(-1, 32).astype(np.uint8)


def within_rows(points: list[np.ndarray], one: np.ndarray, two: np.ndarray, edits: int, each: int = 0) -> np.ndarray:
    """Whether points[i] and points[j] are within ``edits``, and within one for every ``each`` code points of the longer, for the pairs (i, j) of ``one`` and ``two``.

    Pairs of short lines go through the bands together, taken from one padded matrix; pairs with a long line are compared one by one.
    """
    verdict = np.zeros(len(one), dtype=bool)
    size = np.array([len(x) for x in points])
    swap = size[one] < size[two]
    one, two = np.where(swap, two, one), np.where(swap, one, two)
    near = size[one] - size[two] <= edits
    short = near & (size[one] <= SHORT) & (size[one] > edits)
    verdict[near & (size[one] <= edits)] = True
    long = np.flatnonzero(near & (size[one] > SHORT))
    verdict[long] = within([(points[i], points[j]) for i, j in zip(one[long].tolist(), two[long].tolist())], edits)
    work = np.flatnonzero(short)
    if len(work):
        pad = 2 * edits + 4
        used = np.unique(np.concatenate([one[work], two[work]]))
        place = np.zeros(len(points), dtype=np.int64)
        place[used] = np.arange(len(used))
        most = int(size[used].max())
        sheet = np.full((len(used), most + edits + 2 * pad), 0xFFFFFFFF, dtype=np.uint32)
        for r, i in enumerate(used.tolist()):
            sheet[r, pad : pad + size[i]] = points[i]
        work = work[np.argsort(size[one[work]], kind="stable")]
        for at in range(0, len(work), 8192):
            some = work[at : at + 8192]
            a, b, m1, m2 = sheet[place[one[some]]], sheet[place[two[some]]], size[one[some]], size[two[some]]
            longest = int(m2.max())
            b = np.where(np.arange(longest)[None] < m2[:, None], b[:, pad : pad + longest], 0xFFFFFFFE)
            verdict[some] = _bands(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), m1, m2, edits) <= edits
    if each:
        allowed = size[one] // each
        for fewer in range(edits):
            some = np.flatnonzero(verdict & (allowed == fewer))
            verdict[some] = within_rows(points, one[some], two[some], fewer) if fewer else [np.array_equal(points[i], points[j]) for i, j in zip(one[some].tolist(), two[some].tolist())]
    return verdict


def _candidates(s: int, e: int, rows: np.ndarray, own: np.ndarray, sketch: np.ndarray, size: np.ndarray, side: tuple, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of each row i of ``rows`` in a cell s to e and the residents of other components that may be within reach, where one of the two is indexed."""
    outside, resident, indexed = side
    asked = np.zeros(e - s, dtype=bool)
    for i in rows.tolist():
        met = (own[s:e] != own[i]) & resident[s:e] & (indexed[s:e] | indexed[i]) & (np.abs(size[s:e] - size[i]) <= edits)
        if resident[i]:
            met &= ~asked  # those have met row i already
            asked[i - s] = True
        near = np.flatnonzero(met)
        near = near[np.abs((sketch[near + s] - sketch[i]).view(np.int8).astype(np.int16)).sum(axis=1) <= 2 * edits] + s
        yield np.full(len(near), i), near


def link_cells(spans: list[tuple[int, int]], own: np.ndarray, points: list[np.ndarray], side: tuple, edits: int, each: int = 0, most: int = 8192) -> list[tuple[int, int]]:
    """Links (i, j) between rows of one cell and different components ``own``; no more than join the components of each cell.

    side: (outside, resident, indexed). First each cell's rows are held against one of them. Then, where all rows are outside, each row that isn't in the cell's
    largest component is compared with all others, else the outside rows with the residents. Pairs of many cells are verified together.
    """
    outside, resident, indexed = side
    own, found = own.copy(), []
    size, sketch = np.array([len(x) for x in points]), _sketch(points)

    def verify(one: list[np.ndarray], two: list[np.ndarray], where: list[tuple[int, int]]) -> None:
        i, j = np.concatenate(one), np.concatenate(two)
        cell = np.repeat(np.arange(len(where)), [len(x) for x in one])
        open_ = own[i] != own[j]
        i, j, cell = i[open_], j[open_], cell[open_]
        ok = within_rows(points, i, j, edits, each)
        for x, y, c in zip(i[ok].tolist(), j[ok].tolist(), cell[ok].tolist()):
            if own[x] != own[y]:
                s, e = where[c]
                own[s:e][own[s:e] == own[y]] = own[x]
                found.append((x, y))

    starts = [s + int(indexed[s:e].argmax()) for s, e in spans]
    hub = np.repeat(starts, [e - s for s, e in spans]).astype(np.int64)
    row = np.concatenate([np.arange(s, e) for s, e in spans])
    good = (own[row] != own[hub]) & (indexed[row] | indexed[hub]) & (np.abs(size[row] - size[hub]) <= edits) & (outside[row] & resident[hub] | outside[hub] & resident[row])
    row, hub = row[good], hub[good]
    off = np.abs((sketch[row] - sketch[hub]).view(np.int8).astype(np.int16)).sum(axis=1)
    row, hub = row[off <= 2 * edits], hub[off <= 2 * edits]
    span = np.searchsorted(np.array([s for s, _ in spans]), row, side="right") - 1
    cuts = np.flatnonzero(np.concatenate([[True], span[1:] != span[:-1], [True]])) if len(row) else np.zeros(1, dtype=int)
    if len(row):
        verify([row[x:y] for x, y in zip(cuts[:-1], cuts[1:])], [hub[x:y] for x, y in zip(cuts[:-1], cuts[1:])], [spans[k] for k in span[cuts[:-1]].tolist()])
    one, two, where, n = [], [], [], 0
    for s, e in spans:
        here = own[s:e]
        if e - s < 3 or (here == here[0]).all():
            continue
        rows = outside[s:e].copy()
        if rows.all():
            names, counts = np.unique(here, return_counts=True)
            rows = here != names[counts.argmax()]
        for i, j in _candidates(s, e, np.flatnonzero(rows) + s, own, sketch, size, side, edits):
            if len(j):
                one.append(i), two.append(j), where.append((s, e))
                n += len(j)
            if n >= most:
                verify(one, two, where)
                one, two, where, n = [], [], [], 0
    if one:
        verify(one, two, where)
    return found


def _cell_links(cells: DataFrame, lines: DataFrame, params: LineParams, partitions: int) -> DataFrame:
    """Links (a, b) found within each cell; cells: (cell, key, indexed, root, outside, resident)."""
    p = params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, "cell"):
            spans = _spans(t)
            if not spans:
                continue
            keys, root, cell = (t.column(c).to_numpy() for c in ("key", "root", "cell"))
            own = np.unique(np.stack([cell, root], axis=1), axis=0, return_inverse=True)[1].ravel()
            points = [_points(x) for x in t.column("line").to_pylist()]
            side = tuple(t.column(c).to_numpy() for c in ("outside", "resident", "indexed"))
            found = np.array(link_cells(spans, own, points, side, p.edits, p.each), dtype=np.int64).reshape(-1, 2)
            a, b = keys[found[:, 0]], keys[found[:, 1]]
            yield pa.record_batch([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    whole = cells.join(lines.select(F.col("ref").alias("key"), "line"), "key")
    columns = ["key", "indexed", "root", "outside", "resident", "line"]
    dealt = whole.select("cell", *columns).repartition(partitions, "cell").sortWithinPartitions("cell", "key")
    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def near_lines(blocks: DataFrame, docs: DataFrame, params: LineParams, partitions: int) -> DataFrame:
    """(node, root): references of the lines that are linked to a different line, and of their component.

    Within a piece of a bucket all lines are compared at once; over the pieces of large buckets only those outside the bucket's main component.
    """
    met = cut(_meetings(blocks, partitions, params.block))
    lines = cut(_texts_of(docs, params).join(met.select("ref").distinct(), "ref", "left_semi").dropDuplicates(["ref"]))
    yes = F.lit(True)
    one = met.select(F.xxhash64("bucket", "piece").alias("cell"), F.col("ref").alias("key"), "indexed", F.col("ref").alias("root"), yes.alias("outside"), yes.alias("resident"))
    links = cut(_cell_links(one, lines, params, partitions))
    roots = cut(connected_components(links))
    large = met.where("pieces > 1").withColumnRenamed("ref", "key")
    named = large.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    visits = outside_rows(named).withColumn("outside", F.col("outside") & ~F.col("resident"))
    more = cut(_cell_links(visits, lines, params, partitions))
    return cut(joined_components(roots, more))


def line_classes(docs: DataFrame, params: LineParams = LineParams(), keys: tuple[str, ...] = ("doc_id",), all_lines: bool = True) -> DataFrame:
    """(*keys, line_no, ref, key, first, class_size): every line that takes part, with its class's first line (struct) and size; first is null where a
    line is alone, which ``all_lines=False`` leaves out.

    Lines are first counted by their text, so a line that stands in a third of all documents travels as one row per task from there on.
    """
    names = list(keys)
    partitions = partitions_for(docs)
    rows = cut(_line_rows(docs, params, names))
    roots = near_lines(_segment_blocks(docs, params, 4 * partitions), docs.select("text"), params, partitions)
    place = F.struct(*[F.struct(F.col(k).isNull().alias("none"), F.col(k).alias("value")).alias(k) for k in names], F.col("line_no"))
    by_line = rows.groupBy("ref", "key").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # What is neither repeated nor linked is done with here.
    some = cut(by_line.join(roots.withColumnRenamed("node", "ref"), "ref", "left").where("n > 1 or root is not null"))
    some = some.withColumn("class_ref", F.coalesce("root", "ref")).withColumn("class_key", F.when(F.col("root").isNull(), F.col("key")).otherwise(F.lit(0).cast("long")))
    classes = some.groupBy("class_ref", "class_key").agg(F.min("first").alias("first"), F.sum("n").alias("class_size"))
    lookup = cut(some.select("ref", "key", "class_ref", "class_key").join(classes, ["class_ref", "class_key"]).where("class_size > 1").select("ref", "key", "first", "class_size"))
    return rows.join(lookup, ["ref", "key"], "left" if all_lines else "inner").withColumn("class_size", F.coalesce("class_size", F.lit(1).cast("long")))


def _is_first() -> Column:
    """Whether a line is the one of its class that stays."""
    return F.col("doc_id").eqNullSafe(F.col("first.doc_id.value")) & (F.col("text_hash") == F.col("first.text_hash.value")) & (F.col("line_no") == F.col("first.line_no"))


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text, row): doc_id and a hash of the text name a row, whatever plan reads it; row is a struct of all columns."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def drop_duplicate_lines(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one; a document of which no word is left goes, a document without words stays as it is.

    Only the numbers of the lines to drop are joined to the documents, gathered per row; a row that loses nothing is passed as it is.
    """
    named = _named(docs)
    found = line_classes(named.select("doc_id", "text_hash", "text"), params, ("doc_id", "text_hash"), all_lines=False)
    drops = found.where(~_is_first()).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.sort_array(F.collect_set("line_no")).alias("drop"))
    joined = named.join(drops, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    # The lines are bound once to a name, so that a long text is split once.
    left = F.expr(r"transform(array(split(text, '\n', -1)), ls -> array_join(transform(array_except(sequence(0, size(ls) - 1), drop), i -> get(ls, i)), '\n'))[0]")
    kept = joined.select("row", "drop", F.when(F.col("drop").isNull(), F.col("text")).otherwise(left).alias("left"))
    kept = kept.where(F.col("drop").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[F.col("left").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with a word with its class: the first line of the class (class_doc_id, class_line_no), its size, and whether this line stays."""
    found = line_classes(_named(table(spark, sf_dir, "documents")).select("doc_id", "text_hash", "text"), keys=("doc_id", "text_hash"))
    alone = F.col("first").isNull()
    return found.select(
        "doc_id", "line_no",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id.value")).alias("class_doc_id"),
        F.when(alone, F.col("line_no")).otherwise(F.col("first.line_no")).alias("class_line_no"),
        "class_size",
        (alone | _is_first()).alias("kept"),
    )
