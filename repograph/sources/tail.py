"""A source of lines that follows growing log files, with a total order that streams can carry.

Each batch takes what was appended to the files of a folder (or one file) since the batch before, up to the last line end, so a line that is still being written waits. A file that is
shorter than what was read of it was truncated or replaced and is read from its start; a file or folder may appear later and vanish again. The offset names the
bytes read of each file and the time of planning, so a batch that is run again after a failure is read and numbered the same. Byte ranges are dealt to tasks; a line belongs
to the range that it begins in, and lines over the cap are dropped without being held.

seq is a decimal of 38 digits: 13 for the milliseconds at which the batch was planned, 8 for the file among the batch's by name, 16 for the line's byte in the file. Batches are numbered by the
driver's clock; a clock that has gone back since the last batch is an error, not a wrong order. ts is the time of planning, when the lines arrived.

Paths need no scheme where all machines share them; with one, Arrow's file systems open them.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "seq decimal(38,0), ts timestamp, file string, value string"
FORMAT = "followed_lines"
BLOCK = 1 << 16


@dataclass
class Range(InputPartition):
    """Bytes of a file; lines that begin from ``start`` on (``begins``: a line does begin there) and before ``stop``, which end before ``end``."""

    path: str
    number: int
    at: int
    start: int
    stop: int
    end: int
    begins: bool


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> dict[str, int]:
    """Size of each file at or below ``path``; hidden ones and those of names with an underscore first are left out."""
    fs, root = _opened(path)
    if fs.get_file_info(root).type == pafs.FileType.File:
        found = [fs.get_file_info(root)]
    else:
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
    return {f.path: f.size for f in found if f.type == pafs.FileType.File and f.base_name[:1] not in "._"}


def _line_end(path: str, name: str, known: int, size: int) -> int:
    """Where the last whole line before ``size`` ends, not before ``known``."""
    fs, _ = _opened(path)
    with fs.open_input_file(name) as f:
        end = size
        while end > known:
            start = max(known, end - BLOCK)
            at = f.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return known


def _ranges(path: str, start: dict[str, int], end: dict[str, int], at: int, most: int) -> list[Range]:
    out = []
    for number, name in enumerate(sorted(end)):
        size, known = end[name], start.get(name, 0)
        first = known if known <= size else 0
        out += [Range(name, number, at, lo, min(lo + most, size), size, lo == first) for lo in range(first, size, most)]
    return out


def _decimals(at: int, number: int, places: np.ndarray) -> pa.Array:
    """The order numbers as Arrow decimals: 128-bit sums of one base and the places."""
    base = (at * 10**8 + number) * 10**16
    low = places.astype(np.uint64) + np.uint64(base & (2**64 - 1))
    high = np.full(len(places), base >> 64, dtype=np.uint64) + (low < places).astype(np.uint64)
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(places), [None, pa.py_buffer(np.stack([low, high], axis=1).tobytes())])


def _lines(path: str, r: Range, cap: int, block: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    fs, _ = _opened(path)
    with fs.open_input_file(r.path) as f:
        at, held, skipping = r.start, b"", False
        if not r.begins:
            at, skipping = r.start - 1, True  # what stands before the first line end belongs to the range before
        begin = at
        while begin < r.stop and (at < r.end or held):
            data = f.read_at(min(block, r.end - at), at) if at < r.end else b""
            whole = held + data
            last = not data or at + len(data) >= r.end
            at += len(data)
            ends = np.flatnonzero(np.frombuffer(whole, dtype=np.uint8) == 10)
            if last and (not len(ends) or ends[-1] + 1 < len(whole)):
                ends = np.append(ends, len(whole))
            starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
            if len(ends):
                own, places = [], []
                for k, (b, e) in enumerate(zip(starts.tolist(), ends.tolist())):
                    if skipping and k == 0:
                        continue
                    if begin + b >= r.stop:
                        break
                    if e - b <= cap:
                        own.append(whole[b:e].removesuffix(b"\r").decode("utf-8", "replace"))
                        places.append(begin + b)
                if own:
                    n = len(own)
                    yield pa.record_batch([_decimals(r.at, r.number, np.array(places, dtype=np.int64)), pa.array([r.at * 1000] * n, pa.timestamp("us", "UTC")), pa.array([r.path] * n), pa.array(own, pa.string())], names=["seq", "ts", "file", "value"])
                begin, held, skipping = begin + int(ends[-1]) + 1, whole[int(ends[-1]) + 1 :], False
            elif len(whole) > cap:
                begin, held, skipping = begin + len(whole), b"", True  # a line over the cap goes on; its end is looked for
            else:
                held = whole
            if last:
                return


class _Settings:
    def __init__(self, options: dict):
        self.path, self.cap, self.most = options["path"], int(options.get("maxlinebytes", options.get("maxLineBytes", 65536))), int(options.get("rangebytes", options.get("rangeBytes", 64 << 20)))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _lines(self.path, partition, self.cap)


class LineReader(_Settings, DataSourceReader):
    """All lines that are there, the last of a file without a line end too."""

    def partitions(self) -> list[Range]:
        return _ranges(self.path, {}, _files(self.path), 0, self.most)


class LineStream(_Settings, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.last = {"at": 0, "files": {}}

    def initialOffset(self) -> dict:
        return {"at": 0, "files": {}}

    def latestOffset(self) -> dict:
        held, now = self.last["files"], {}
        for name, size in _files(self.path).items():
            known = held.get(name, 0)
            try:
                end = _line_end(self.path, name, known if known <= size else 0, size)
            except OSError:  # gone since it was listed
                continue
            if end:
                now[name] = end
        if now != held:
            self.last = {"at": max(int(time.time() * 1000), self.last["at"] + 1), "files": now}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if end["files"] == start["files"]:
            return []
        if end["at"] <= start["at"]:
            raise ValueError("the driver's clock is behind that of the last batch, so lines can't be numbered in order")
        if end["at"] > self.last["at"]:
            self.last = end
        changed = {name: size for name, size in end["files"].items() if size != start["files"].get(name)}
        return _ranges(self.path, start["files"], changed, end["at"], self.most)


class FollowedLines(DataSource):
    """``spark.read`` or ``spark.readStream.format("followed_lines").option("path", folder)``; options maxLineBytes and rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)

    def streamReader(self, schema) -> LineStream:
        return LineStream(self.options)


def followed_lines(spark: SparkSession, path: str, streaming: bool = True, max_line_bytes: int = 65536, range_bytes: int = 64 << 20):
    """(seq, ts, file, value) of the lines of growing files at ``path``."""
    spark.dataSource.register(FollowedLines)
    reader = spark.readStream if streaming else spark.read
    return reader.format(FORMAT).option("path", path).option("maxLineBytes", max_line_bytes).option("rangeBytes", range_bytes).load()
