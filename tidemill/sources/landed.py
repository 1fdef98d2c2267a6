"""Landed posts as a registered data source: ``spark.read.format("landed")`` and ``spark.readStream.format("landed")``.

Posts are landed by :func:`land` under ``lot=<n>``, a lot being ``LOT`` successive keys, as files of JSON lines. A lot's name bounds
its keys, so a read beyond a cursor opens only the lots that can hold later ones, one task for each. Filters on the source
and the key are taken over by the reader. A stream's offset is the cursor itself: the greatest key that was landed when
a batch was planned; a batch holds the keys after one cursor up to the next, so a restart from a checkpoint repeats nothing, and
keys that land behind the cursor are not read, as with :func:`tidemill.sources.feeds.fetch_new`.

Options: ``path`` (a folder that all tasks reach, as any file system URI), ``source`` (only this one), ``from`` (a first cursor).

Defined results: a folder that does not exist holds no rows; a line without a key, or that is no JSON, is skipped; missing fields are
null; other fields are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Keys of a lot, rows of a batch handed to the engine.
LOT, ROWS = 1000, 4096
SCHEMA = "key long, source string, external_id string, text string, posted_at timestamp, fetched_at timestamp"
_TYPES = [("key", pa.int64()), ("source", pa.string()), ("external_id", pa.string()), ("text", pa.string()), ("posted_at", pa.timestamp("us", "UTC")), ("fetched_at", pa.timestamp("us", "UTC"))]
_LAST = (1 << 63) - 1


def land(posts: DataFrame, path: str) -> None:
    """Append posts (the columns of ``SCHEMA``) to a folder, times in microseconds."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    shaped = posts.where("key is not null").select(*(F.unix_micros(c).alias(c) if c.endswith("_at") else F.col(c) for c in columns), F.floor(F.col("key") / LOT).alias("lot"))
    shaped.repartition("lot").write.mode("append").partitionBy("lot").json(path)


class Lot(InputPartition):
    """Files of one lot, and the keys that are wanted of it: after ``low``, up to ``high``."""

    def __init__(self, files: list[str], low: int, high: int):
        super().__init__((files, low, high))
        self.files, self.low, self.high = files, low, high


class Landed:
    """A folder of lots."""

    def __init__(self, path: str):
        found, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.files = found

    def lots(self) -> dict[int, list[str]]:
        """Files by lot, listed anew."""
        out: dict[int, list[str]] = {}
        for f in self.files.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            m = re.search(r"/lot=(-?\d+)/[^/_.][^/]*$", f.path)
            if m and f.type == fs.FileType.File:
                out.setdefault(int(m[1]), []).append(f.path)
        return {k: sorted(out[k]) for k in sorted(out)}

    def rows(self, files: list[str], low: int, high: int, source: str | None) -> Iterator[tuple]:
        for name in files:
            with self.files.open_input_stream(name, compression="detect") as f:
                held = b""
                while block := f.read(1 << 20):
                    *lines, held = (held + block).split(b"\n")
                    yield from self._parsed(lines, low, high, source)
                yield from self._parsed([held], low, high, source)

    def _parsed(self, lines: list[bytes], low: int, high: int, source: str | None) -> Iterator[tuple]:
        for line in lines:
            try:
                r = json.loads(line) if line.strip() else None
            except ValueError:
                r = None
            if isinstance(r, dict) and isinstance(r.get("key"), int) and low < r["key"] <= high and source in (None, r.get("source")):
                yield tuple(r.get(name) for name, _ in _TYPES)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, (_, kind) in enumerate(_TYPES)], names=[n for n, _ in _TYPES])

    for r in rows:
        held.append(r)
        if len(held) == ROWS:
            yield done()
            held = []
    if held:
        yield done()


class LandedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.source = options["path"], options.get("source")
        self.low, self.high = int(options.get("from", -_LAST - 1)), _LAST

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the key and one source are read off; other filters are left to the engine."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            if name == "key" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value - isinstance(f, GreaterThanOrEqual))
            elif name == "key" and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            elif name == "key" and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value - 1), min(self.high, f.value)
            elif name == "source" and isinstance(f, EqualTo) and self.source in (None, f.value):
                self.source = f.value
            else:
                yield f

    def partitions(self) -> list[Lot]:
        lots = Landed(self.path).lots()
        return [Lot(files, self.low, self.high) for k, files in lots.items() if (k + 1) * LOT > self.low + 1 and k * LOT <= self.high] or [Lot([], 0, 0)]

    def read(self, partition: Lot) -> Iterator[pa.RecordBatch]:
        return _batches(Landed(self.path).rows(partition.files, partition.low, partition.high, self.source))


class LandedStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.source = options["path"], options.get("source")
        self.first = int(options.get("from", -_LAST - 1))

    def initialOffset(self) -> dict:
        return {"cursor": self.first}

    def latestOffset(self) -> dict:
        """The greatest landed key: only the last lot is opened for it."""
        folder = Landed(self.path)
        lots = folder.lots()
        while lots:
            top = max((r[0] for r in folder.rows(lots.popitem()[1], -_LAST - 1, _LAST, None)), default=None)
            if top is not None:
                return {"cursor": max(top, self.first)}
        return {"cursor": self.first}

    def partitions(self, start: dict, end: dict) -> list[Lot]:
        low, high = start["cursor"], end["cursor"]
        return [Lot(files, low, high) for k, files in Landed(self.path).lots().items() if (k + 1) * LOT > low + 1 and k * LOT <= high] or [Lot([], 0, 0)]

    def read(self, partition: Lot) -> Iterator[pa.RecordBatch]:
        return _batches(Landed(self.path).rows(partition.files, partition.low, partition.high, self.source))

    def commit(self, end: dict) -> None:
        """The checkpoint keeps the cursor."""


class LandedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> LandedReader:
        return LandedReader(dict(self.options))

    def streamReader(self, schema: object) -> LandedStream:
        return LandedStream(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session, and let it take over filters."""
    spark.dataSource.register(LandedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
