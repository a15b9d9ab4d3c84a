"""Bounded-space online packing of documents into fixed token windows.

Each partition packs on its own, without a shuffle: a document longer than a window is cut into full windows and a
rest; a rest goes into the open window that it fills best; if it fits into none and ``open_windows`` are open, the
fullest is emitted with padding and a new one opened. At the end of a partition the windows still open are merged:
best-fit, fullest first; what is then still under ``full`` of a window is poured together, cut at full windows, and the
last tokens are cut into sequences whose lengths are powers of two, which need no padding.

Edge cases: null or empty text is a document of the end token alone; repeated rows are packed as often as they
occur; an empty table gives no rows; columns other than the id and the text are ignored. Sequence ids are unique
(partition number in the upper bits) and the same whenever the same splits are read again.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy
from .tokens import default_vocabulary, encoder_for

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
Piece = tuple  # (doc_id, start, ids, doc_tokens)


class Packer:
    """Open windows of one partition, kept sorted by free room."""

    def __init__(self, window: int, open_windows: int, full: float):
        self.window, self.most, self.full = window, open_windows, full
        self.open: list[tuple[int, int, list[Piece]]] = []  # (room, number, pieces)
        self.number = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Places one piece; yields the windows that it completes or drives out."""
        size = len(piece[2]) // 4
        if size == self.window:
            yield [piece]
            return
        at = bisect.bisect_left(self.open, (size,))
        if at == len(self.open) and len(self.open) == self.most:
            yield self.open.pop(0)[2]
        room, number, pieces = self.open.pop(at) if at < len(self.open) else (self.window, self.number, [])
        self.number += 1
        pieces.append(piece)
        if room == size:
            yield pieces
        else:
            bisect.insort(self.open, (room - size, number, pieces), key=lambda w: w[:2])

    def close(self) -> Iterator[list[Piece]]:
        """Merges the windows still open."""
        merged: list[tuple[int, int, list[Piece]]] = []
        for room, number, pieces in self.open:
            at = bisect.bisect_left(merged, (self.window - room,))
            if at < len(merged):
                free, number, into = merged.pop(at)
                room, pieces = free - (self.window - room), into + pieces
            bisect.insort(merged, (room, number, pieces), key=lambda w: w[:2])
        self.open = []
        rest: list[Piece] = []
        for room, _, pieces in merged:
            if room <= (1 - self.full) * self.window:
                yield pieces
            else:
                rest += pieces
        left = sum(len(p[2]) // 4 for p in rest)
        rest.reverse()
        while left:
            size = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            left -= size
            taken: list[Piece] = []
            while size:
                doc, start, ids, total = rest.pop()
                taken.append((doc, start, ids[: 4 * size], total))
                if len(ids) > 4 * size:
                    rest.append((doc, start + size, ids[4 * size :], total))
                size -= len(taken[-1][2]) // 4
            yield taken


def pack_documents(docs: DataFrame, vocabulary: str | None = None, window: int = 4096, open_windows: int = 64, end_id: int = 2, full: float = 0.99, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: its document, the place of its tokens there and in its sequence, and the ids (little-endian 32-bit)."""
    path = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encoder_for(path), Packer(window, open_windows, full)
        end = int(end_id).to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held = 0

        def emit(pieces: list[Piece]) -> None:
            nonlocal sequence, held
            offset = 0
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                rows.append((doc, start, n, ids, total, sequence, offset))
                offset += n
            held += offset
            sequence += 1

        def flush() -> pa.RecordBatch:
            nonlocal held
            out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            rows.clear()
            held = 0
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # few texts at a time stand in memory in all their forms
                some = batch.slice(at, 256)
                for doc, coded in zip(some.column(0).to_pylist(), encoder.encode([t or "" for t in some.column(1).to_pylist()])):
                    ids = coded.tobytes() + end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        for done in packer.add((doc, start, ids[4 * start : 4 * (start + window)], total)):
                            emit(done)
                if held >= 1 << 18:
                    yield flush()
        for done in packer.close():
            emit(done)
        if rows:
            yield flush()
        encoder.forget()  # a worker that waits for its next task holds the tokenizer alone

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(tidy(run), SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens; ids are given by their checksum."""
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
