"""A reader of large JSON arrays that splits files into byte ranges.

Spark's multi-line reader takes a file in one task.  Here each range of a file
is scanned twice.  First it says how many quotes it holds and how its brackets
change the depth, for either state that it may begin in; these few numbers a
range are put together on the driver, so each range's true state is known.
Then each range cuts out the elements that begin in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.sources.folders import arrow_path, hadoop_path

#: Bytes of a range.
SPLIT = 8 << 20
QUOTE, BACKSLASH, COMMA = 0x22, 0x5C, 0x2C
OPEN, CLOSE = (0x5B, 0x7B), (0x5D, 0x7D)
ELEMENTS = "file string, offset long, json string"


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, length) of the files that a path, folder or glob names; hidden ones are left out."""
    fs, p = hadoop_path(spark, path)
    found = []
    for s in fs.globStatus(p) or []:
        inner = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
        found += [(f.getPath().toString(), f.getLen()) for f in inner if f.isFile() and f.getPath().getName()[0] not in "._"]
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


class Bytes:
    """Ranges of one file, read where the task is."""

    def __init__(self, uri: str):
        fs, path = arrow_path(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, end: int) -> np.ndarray:
        end = min(end, self.size)
        return np.frombuffer(self.file.read_at(max(0, end - start), start), np.uint8) if start < end else np.zeros(0, np.uint8)

    def escaped(self, start: int) -> bool:
        """Whether an odd number of backslashes stands right before ``start``."""
        n, at = 0, start
        while at > 0:
            part = self.read(max(0, at - 4096), at)
            back = part[::-1] != BACKSLASH
            if back.any():
                return (n + int(back.argmax())) % 2 == 1
            n, at = n + len(part), at - len(part)
        return n % 2 == 1


def quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Where quotes open or close a string."""
    at = np.arange(len(data), dtype=np.int32)
    plain = np.maximum.accumulate(np.where(data != BACKSLASH, at, np.int32(-1)))
    before = np.concatenate([[np.int32(-1)], plain[:-1]]) if len(data) else plain
    run = at - 1 - before + np.where(before < 0, np.int32(escaped), 0)
    return (data == QUOTE) & (run % 2 == 0)


def _steps(data: np.ndarray) -> np.ndarray:
    """By how much each byte would change the depth outside strings."""
    return (np.isin(data, OPEN).astype(np.int8) - np.isin(data, CLOSE).astype(np.int8)).astype(np.int8)


def summary(data: np.ndarray, escaped: bool) -> tuple[int, int, int]:
    """(quotes, change of depth if the range begins outside a string, if inside)."""
    q, steps = quotes(data, escaped), _steps(data)
    outside = np.cumsum(q, dtype=np.int32) % 2 == 0
    return int(q.sum()), int(steps[outside].sum()), int(steps[~outside].sum())


def cuts(data: np.ndarray, escaped: bool, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray, bool, int]:
    """Places of the marks that begin an element, of those that end the array, and the state behind the data."""
    q = quotes(data, escaped)
    free = (np.cumsum(q, dtype=np.int32) + int(inside)) % 2 == 0
    steps = np.where(free, _steps(data), 0)
    after = np.cumsum(steps, dtype=np.int32) + np.int32(depth)
    begins = free & (((data == COMMA) & (after == 1)) | ((data == OPEN[0]) & (steps == 1) & (after == 1)))
    ends = free & (data == CLOSE[0]) & (after == 0)
    return np.flatnonzero(begins), np.flatnonzero(ends), bool((int(q.sum()) + inside) % 2), int(after[-1]) if len(data) else depth


def elements(source: Bytes, start: int, end: int, inside: bool, depth: int, more: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of the elements whose first mark lies in the range; the last one is read to its end."""
    data = source.read(start, end)
    begins, ends, inside, depth = cuts(data, source.escaped(start), inside, depth)
    if not len(begins):
        return
    marks = np.sort(np.concatenate([begins, ends]))
    stops = marks[np.searchsorted(marks, begins, "right").clip(max=len(marks) - 1)]
    raw = data.tobytes()
    for a, b in zip(begins.tolist(), stops.tolist()):
        if b > a:
            yield start + a + 1, raw[a + 1 : b]
    if begins[-1] < marks[-1]:
        return
    last, at = [raw[int(begins[-1]) + 1 :]], end
    while at < source.size:
        data = source.read(at, at + more)
        b, e, inside, depth = cuts(data, source.escaped(at), inside, depth)
        stop = min([int(x[0]) for x in (b, e) if len(x)], default=None)
        last.append(data[:stop].tobytes())
        if stop is not None:
            yield start + int(begins[-1]) + 1, b"".join(last)
            return
        at, more = at + len(data), min(2 * more, SPLIT)
    raise ValueError("the array isn't closed")


def read_elements(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """file, offset (of the byte) and json of every element of the JSON arrays at ``path``.

    A file that holds one object instead of an array is one element.  Empty
    arrays and files have none; an array that isn't closed raises.
    """
    files = _files(spark, path)
    ranges = [(f, a, min(a + split, n)) for f, n in files for a in range(0, n, split)]
    if not ranges:
        return spark.createDataFrame([], ELEMENTS)
    tasks = min(len(ranges), max(4 * spark.sparkContext.defaultParallelism, len(ranges) // 8))

    def scan(batches):
        for pdf in batches:
            rows = []
            for i in pdf["id"].tolist():
                f, a, b = ranges[i]
                source = Bytes(f)
                head = source.read(0, 4096).tobytes().lstrip(b"\xef\xbb\xbf \t\r\n")[:1] if a == 0 else b""
                rows.append((i, *summary(source.read(a, b), source.escaped(a)), head == b"{"))
            yield pd.DataFrame(rows, columns=["id", "quotes", "free", "held", "object"])

    # Ranges of one file are read by neighbouring tasks; a row a range comes to the driver
    numbers = spark.range(len(ranges), numPartitions=tasks)
    found = sorted(numbers.mapInPandas(scan, "id long, quotes long, free long, held long, object boolean").collect())
    states, inside, depth, whole = [], False, 0, set()
    for r in found:
        f, a, _ = ranges[r["id"]]
        if a == 0:
            inside, depth = False, 0
            whole |= {f} if r["object"] else set()
        states.append((inside, depth))
        depth += r["held"] if inside else r["free"]
        inside = inside != (r["quotes"] % 2 == 1)

    def read(batches):
        for pdf in batches:
            for i in pdf["id"].tolist():
                f, a, b = ranges[i]
                source = Bytes(f)
                if f in whole:
                    got = [(0, source.read(0, source.size).tobytes())] if a == 0 else []
                else:
                    got = elements(source, a, b, *states[i])
                rows, size = [], 0
                for at, text in got:
                    if text.strip():
                        rows.append((f, at, text.decode("utf-8")))
                        size += len(text)
                    if size > SPLIT:
                        yield pd.DataFrame(rows, columns=["file", "offset", "json"])
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=["file", "offset", "json"])

    return spark.range(len(ranges), numPartitions=tasks).mapInPandas(read, ELEMENTS)


def read_json_array(spark: SparkSession, path: str, schema: str, strict: bool = True, split: int = SPLIT) -> DataFrame:
    """Rows of the arrays' elements; elements that don't fit the schema raise, or are rows of nulls if not ``strict``."""
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    return read_elements(spark, path, split).select(F.from_json("json", schema, mode).alias("r")).select("r.*")
