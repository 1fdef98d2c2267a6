"""Sharding along a Hilbert curve over several metadata dimensions.

Every dimension is quantised to ``BITS`` bits, the Hilbert index of the cell is computed with array functions, the
rows are range-partitioned and sorted by (index, id, ties), and the sorted sequence is cut into runs whose row
counts differ by one at most. Files of a run then hold narrow ranges of every dimension, so min-max statistics
prune them for filters on any of the dimensions.

The place of a row is its number in its sorted partition plus the counts of the partitions before it, so no task
and no driver sees more than its own partition; a source with a third of all rows is cut wherever a run ends,
because the id is part of the sort.

Quantisation needs only each dimension's smallest and largest value. Numbers: by the logarithm of their distance
from the smallest value (``log``) or linearly (``linear``). Texts: by the first three characters after the prefix
that all values share, which keeps their order. Null is the lowest cell.

The sorted partitions are written once, in the shared folder, with all columns of the input, texts too: these files
are runs of the curve. Everything afterwards is read back from them, so a repeated task cannot move a row.

Defined results: nulls in a dimension are its lowest cell; repeated rows get a place each; an empty table gives no
rows; columns of the input pass through, whatever their names, except that ``curve``, ``shard`` and ``slot`` are
replaced where the input has them.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.names import unused, without
from tidemill.session import stage

BITS = 5
N_SHARDS = 16
#: Rows of a sorted run, about: with more of them there are more runs than the session's shuffle partitions.
RUN_ROWS = 100_000
#: Dimensions of the documents table and how each is quantised.
DIMENSIONS = (("source", "text"), ("lang", "text"), ("n_chars", "log"), ("doc_id", "linear"))


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """The Hilbert curve in ``dims`` dimensions as an automaton: digit and next state, by state * 2**dims + cell.

    A state is the corner where the curve enters a sub-cube and the axis along which it leaves it.
    """
    n, size = dims, 1 << dims
    mask = size - 1

    def rotate(x: int, by: int) -> int:
        by %= n
        return ((x << by) | (x >> (n - by))) & mask

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    def trailing(i: int) -> int:
        return ((i & -i).bit_length() - 1) % n if i else 0

    order = {gray(i): i for i in range(size)}
    digit, follow = [], []
    for state in range(size * n):
        corner, axis = divmod(state, n)
        for cell in range(size):
            w = order[rotate(cell ^ corner, -(axis + 1))]
            enter = gray(2 * ((w - 1) // 2)) if w else 0
            digit.append(w)
            follow.append((corner ^ rotate(enter, axis + 1)) * n + (axis + trailing(w + w % 2) + 1) % n)
    return digit, follow


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Index along the curve of a cell given by one number of ``bits`` bits for each dimension."""
    digit, follow = (F.array(*map(F.lit, t)) for t in curve_tables(len(cells)))
    size = 1 << len(cells)

    def step(a: Column, i: Column) -> Column:
        at = a["state"] * size
        for k, c in enumerate(cells):
            at = at + (F.floor(c / F.pow(F.lit(2.0), i)).cast("int") % 2) * (1 << k)
        return F.struct((a["index"] * size + F.get(digit, at)).cast("long").alias("index"), F.get(follow, at).cast("int").alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda a: a["index"])


def _text_number(value: Column, skip: int) -> Column:
    """Number of the three characters after ``skip``, in the order of the texts."""
    code = [F.least(F.ascii(F.substring(value, skip + 1 + k, 1)), F.lit(255)) for k in range(3)]
    return (code[0] * 65536 + code[1] * 256 + code[2]).cast("double")


def quantise(df: DataFrame, dimensions: tuple[tuple[str, str], ...], bits: int = BITS) -> list[Column]:
    """Cell number of every dimension. One pass over narrow columns finds each dimension's range."""
    top = (1 << bits) - 1
    found = df.agg(*(f(c).alias(f"{n}_{k}") for k, (c, _) in enumerate(dimensions) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    cells = []
    for k, (name, kind) in enumerate(dimensions):
        lo, hi, value = found[f"lo_{k}"], found[f"hi_{k}"], F.col(name)
        if lo is None or lo == hi:
            cells.append(F.lit(0))
            continue
        if kind == "text":
            skip = len(os.path.commonprefix([lo, hi]))

            def plain(s: str, skip: int = skip) -> float:
                return float(sum(min(ord(s[skip + k]), 255) << (16 - 8 * k) for k in range(3) if skip + k < len(s)))

            lo, hi, value = plain(lo), plain(hi), _text_number(value, skip)
        value = value.cast("double") - float(lo)
        span = float(hi) - float(lo)
        share = F.log2(value + 1) / F.log2(F.lit(span + 1)) if kind == "log" else value / F.lit(max(span, 1.0))
        cells.append(F.coalesce(F.least(F.greatest(F.floor(share * top) + 1, F.lit(1)), F.lit(top)), F.lit(0)).cast("int"))
    return cells


def shards(df: DataFrame, dimensions: tuple[tuple[str, str], ...] = DIMENSIONS, n_shards: int = N_SHARDS, ties: tuple[str, ...] = ("doc_id",), bits: int = BITS) -> DataFrame:
    """All rows with ``curve`` (Hilbert index), ``shard`` and ``slot`` (place in the shard, from 0)."""
    spark = df.sparkSession
    columns = without(df, "curve", "shard", "slot")
    df = df.select(*columns)
    place, part, before, rank = unused(df, "row_place", "part", "before", "rank")
    order = ["curve", *ties]
    indexed = df.withColumn("curve", hilbert_index(quantise(df, dimensions, bits), bits))
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RUN_ROWS))
    # the id counts rows of a sorted partition in its lower 33 bits; written once, so that a repeated task cannot change it
    ordered = indexed.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    ordered = stage(ordered, "curve")
    part_of = F.shiftrightunsigned(place, 33)
    counts = sorted((r[0], r[1]) for r in ordered.groupBy(part_of.alias(part)).agg(F.count(F.lit(1))).collect())  # a row for each shuffle partition
    total = sum(n for _, n in counts)
    done, firsts = 0, []
    for p, n in counts:
        firsts.append((p, done))
        done += n
    offsets = spark.createDataFrame(firsts, f"{part} long, {before} long")
    placed = ordered.withColumn(part, part_of).join(F.broadcast(offsets), part)
    placed = placed.withColumn(rank, F.col(before) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)))
    shard = F.expr(f"cast({rank} * {n_shards} div {max(total, 1)} as int)")
    return placed.withColumn("shard", shard).select(*columns, "curve", "shard", F.expr(f"{rank} - (cast(shard as bigint) * {total} + {n_shards - 1}) div {n_shards}").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the rows as one folder of Parquet files for each shard.

    The rows come from sorted runs that a shard's end cuts, so nothing is shuffled: a task writes to the folders of
    its own run only, in slot order.
    """
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
