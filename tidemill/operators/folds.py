"""Folds over the ordered rows of a key, cut over many tasks also where one key has most of the rows.

Rows are range-partitioned by key and order and written once, so a hot key lies in many chunks. A chunk tells, for the keys at
its two ends (all others lie in it whole), what it does to any state that may come in: a function of the state. Functions of
one key are composed in the order of its chunks, which gives the state that each chunk starts from. So no task reads more than
a chunk, and what is composed is a row or two for each chunk.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import stage

#: (Chunk, key) start states that are sent to every task; with more of them the join shuffles.
BROADCAST_STARTS = 200_000
#: Rows that are handed on together.
TOGETHER = 1000


class Fold:
    """What a fold does with the rows of one key: a chunk's rows come as a frame in order."""

    start: Any = None

    def function(self, rows: pd.DataFrame) -> Any:
        """What these rows do to a state, in small."""
        raise NotImplementedError

    def after(self, function: Any, state: Any) -> Any:
        """The state after rows of a function."""
        raise NotImplementedError

    def through(self, rows: pd.DataFrame, state: Any) -> Any:
        """The state after rows that are all there."""
        return self.after(self.function(rows), state)

    def read(self, rows: pd.DataFrame, state: Any) -> dict[str, list]:
        """Columns of what each row gives, from a state on."""
        raise NotImplementedError


def chunked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows with ``_chunk`` and ``_at`` (place in order), written once."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    return stage(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_chunk", F.shiftrightunsigned("_at", 33).cast("int")), "chunks")


def _in_order(chunks: DataFrame) -> DataFrame:
    n = max(1, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return chunks.repartition(n, "_chunk").sortWithinPartitions("_chunk", "_at")


def _segments(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Any, pd.DataFrame]]:
    """(chunk, key, its rows) one after another: a key's rows of one chunk together."""
    held: list[pd.DataFrame] = []
    now: tuple | None = None

    def whole() -> pd.DataFrame:
        return held[0].reset_index(drop=True) if len(held) == 1 else pd.concat(held, ignore_index=True)

    for batch in batches:
        if not batch.num_rows:
            continue
        frame = batch.to_pandas(integer_object_nulls=True)
        keys = frame[key].astype(object).where(frame[key].notna(), None)
        new = ((frame["_chunk"] != frame["_chunk"].shift()) | (keys != keys.shift())).to_numpy()
        places, at = keys.to_numpy(dtype=object), frame["_chunk"].to_numpy()
        begins = np.flatnonzero(new).tolist()
        for lo, hi in zip(begins, [*begins[1:], len(frame)], strict=True):
            this = (int(at[lo]), places[lo])
            if this != now and held:
                yield *now, whole()
                held = []
            now = this
            held.append(frame.iloc[lo:hi])
    if held:
        yield *now, whole()


def starts(chunks: DataFrame, key: str, fold: Fold) -> DataFrame:
    """``_chunk, _key, _start`` (a pickled state) of every chunk that a key goes on in; chunks not listed start afresh."""
    spread = chunks.groupBy(F.col(key).alias("_key")).agg(F.min("_chunk").alias("lo"), F.max("_chunk").alias("hi")).where("lo < hi")
    spread = stage(spread, "cut-keys")
    few = spread.count() <= BROADCAST_STARTS
    cut = chunks.join(F.broadcast(spread) if few else spread, F.col(key).eqNullSafe(F.col("_key")), "left_semi")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, k, rows in _segments(batches, key):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([k], kind), pa.array([pickle.dumps(fold.function(rows))], pa.binary())], names=["_chunk", "_key", "f"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(chunks.schema[key].dataType)
    name = chunks.schema[key].dataType.simpleString()
    functions = stage(_in_order(cut).mapInArrow(told, f"_chunk int, _key {name}, f binary"), "functions")

    def composed(frame: pd.DataFrame) -> pd.DataFrame:
        frame, state, out = frame.sort_values("_chunk"), fold.start, []
        for f in frame["f"]:
            out.append(pickle.dumps(state))
            state = fold.after(pickle.loads(f), state)
        return frame.assign(_start=out)[["_chunk", "_key", "_start"]]

    return stage(functions.groupBy("_key").applyInPandas(composed, f"_chunk int, _key {name}, _start binary"), "starts")


def folded(rows: DataFrame, key: str, order: list[str], fold: Fold, schema: str) -> DataFrame:
    """The rows with the columns of ``schema`` that the fold gives each of them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    chunks = chunked(rows, key, order)
    from_ = starts(chunks, key, fold)
    few = from_.count() <= BROADCAST_STARTS
    begin = (F.broadcast(from_) if few else from_).withColumnRenamed("_chunk", "_c")
    joined = chunks.join(begin, (F.col("_chunk") == F.col("_c")) & F.col(key).eqNullSafe(F.col("_key")), "left").drop("_c", "_key")
    given = rows.schema
    full = rows.sparkSession.createDataFrame([], schema).schema
    out = type(given)([*given.fields, *full.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for _, _, part in _segments(batches, key):
            begun = part["_start"].iloc[0]
            found = fold.read(part, fold.start if begun is None or isinstance(begun, float) else pickle.loads(begun))
            yield from pa.Table.from_pandas(part[given.names].assign(**found), arrow, preserve_index=False).to_batches()

    return _in_order(joined).mapInArrow(run, out)


def final(rows: DataFrame, key: str, order: list[str], fold: Fold, show: Callable[[Any], tuple], schema: str) -> DataFrame:
    """``key`` and the columns of ``schema`` that ``show`` makes of the state after all its rows.

    A key that lies in one chunk is shown where it is read; only those at the ends of chunks, two a chunk, are composed.
    """
    name = rows.schema[key].dataType.simpleString()
    chunks = chunked(rows, key, order)
    shown = rows.sparkSession.createDataFrame([], schema).schema

    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

    kind, kinds = to_arrow_type(rows.schema[key].dataType), to_arrow_schema(shown)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = pa.schema([("_chunk", pa.int32()), (key, kind), ("f", pa.binary()), *((f.name, f.type) for f in kinds)])
        none, out = (None,) * len(kinds), []

        def row(chunk: int, k: Any, part: pd.DataFrame, whole: bool) -> tuple:
            return (chunk, k, None, *show(fold.through(part, fold.start))) if whole else (chunk, k, pickle.dumps(fold.function(part)), *none)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*out, strict=True), into, strict=True)], schema=into)

        # only the first and the last key of a chunk may lie in others too
        before, held = None, None
        for segment in _segments(batches, key):
            if held is not None:
                out.append(row(*held, held[0] == before == segment[0]))
                before = held[0]
                if len(out) == TOGETHER:
                    yield batch()
                    out.clear()
            held = segment
        if held is not None:
            out.append(row(*held, False))
            yield batch()

    read = stage(_in_order(chunks).mapInArrow(told, f"_chunk int, {key} {name}, f binary, {schema}"), "folded")

    def composed(frame: pd.DataFrame) -> pd.DataFrame:
        state = fold.start
        for f in frame.sort_values("_chunk")["f"]:
            state = fold.after(pickle.loads(f), state)
        return pd.DataFrame([(frame[key].iloc[0], *show(state))], columns=[key, *shown.names])

    cut = read.where("f is not null").select("_chunk", key, "f").groupBy(key).applyInPandas(composed, f"{key} {name}, {schema}")
    return read.where("f is null").select(key, *shown.names).unionByName(cut)
