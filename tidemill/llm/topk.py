"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to integers. Inside a block of rows every attribute is stored as bit slices: one bitmap
for each bit of (value - smallest value of the block). A query's score is a sum of slices with the query's
components as weights, added up as bitmaps by carry-save adders, 64 rows a machine word. Negative weights use
complemented slices, so all terms are positive. The score's own slices then give the top rows: from the most
significant slice downward, rows that have the bit are kept while at least k remain; the rows that are still tied
at the end are resolved by id. Only the rows found get their scores computed, from the integers that their bits give.

``build_index`` writes the index once: a row for each block, dealt by a hash of the id, with its slices packed (about
a byte a component); vectors of each length have as many blocks as their own number asks for. ``search_index`` streams
the queries past it: a task holds one block at a time and reads its queries batch by batch, so a block's slices
move once, or a few times where there are more cores than blocks, however many queries there are. A query's best rows
of all blocks are merged by a ranked window. Nothing but block-wise top rows is kept, and there is no pair of rows in any table.

Integers have any width: vectors with a component beyond ``WIDE`` are dealt to blocks of their own, where values are
Python integers, so that scores are exact and other blocks stay compact.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; empty vectors score 0
with each other; vectors of different lengths are compared only with their own kind; repeated ids are separate
candidates, and none of them is a candidate of a query with the same id; ties go to the smaller id; fewer than k
candidates give all of them; a score beyond the range of a long is ranked exactly and shown as that range's end; an
empty table or no query gives no rows; a null id takes no part; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import stage

K = 20
SCALE = 64
#: Rows of a block at most (bitmaps of 8 kB), components of a block at most, queries of a task at least where a block has several.
BLOCK, CELLS, LEAST_CHUNK = 1 << 16, 1 << 22, 256
#: Different lengths of vectors, a row each, that are sent to every task; with more of them rows are shuffled by length.
BROADCAST_WIDTHS = 100_000
#: Quantised components from here on are kept as Python integers; below, sums of any usual width fit a machine word.
WIDE = 1 << 24
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1

Bitmap = np.ndarray


def _bitmap(bits: np.ndarray) -> Bitmap:
    packed = np.packbits(bits, bitorder="little")
    return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)


def quantised(vector: list[float], scale: float) -> list[int]:
    """floor(scale * x), without overflow for large x."""
    return [math.floor(x * scale) if abs(x) < 1 << 53 else math.floor(Fraction(x) * Fraction(scale)) for x in vector]


class Slices:
    """Bit-sliced index of a block: each attribute's least value, and a table of bitmaps of what is above it."""

    def __init__(self, rows: int, least: list[int], counts: list[int], table: np.ndarray):
        self.rows, self.least, self.counts, self.table = rows, least, counts, table
        self.every = _bitmap(np.ones(rows, dtype=np.uint8))
        opposite, ends = self.every & ~table, np.cumsum(counts).tolist()
        self.plain, self.opposite = ([list(t[e - n : e]) for e, n in zip(ends, counts, strict=True)] for t in (table, opposite))

    @classmethod
    def of(cls, values: np.ndarray) -> Slices:
        """From a (rows, attributes) array of integers, of Python integers where its type is object."""
        least, counts, slices = [int(c.min()) for c in values.T], [], []
        for column, low in zip(values.T, least, strict=True):
            above = column - low
            counts.append(int(above.max()).bit_length())
            slices += [_bitmap(((above >> b) & 1).astype(np.uint8)) for b in range(counts[-1])]
        return cls(len(values), least, counts, np.array(slices, dtype=np.uint64).reshape(len(slices), -(-len(values) // 64)))

    def scores(self, rows: np.ndarray, weights: list[int]) -> list[int]:
        """Exact scores of some rows, from the bits of their values."""
        base = sum(w * v for w, v in zip(weights, self.least, strict=True))
        each = [w << b for w, n in zip(weights, self.counts, strict=True) for b in range(n)]
        bits = (self.table[:, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
        if sum(map(abs, each)) < 1 << 62:
            return [base + int(s) for s in np.array(each, dtype=np.int64) @ bits.astype(np.int64)]
        return [base + sum(e for e, bit in zip(each, column, strict=True) if bit) for column in bits.T.tolist()]

    def score(self, weights: list[int]) -> list[Bitmap]:
        """Slices of the weighted sum, least significant first, up to a constant."""
        waiting: list[list[Bitmap]] = []

        def put(at: int, bitmap: Bitmap) -> None:
            while len(waiting) <= at:
                waiting.append([])
            waiting[at].append(bitmap)

        for weight, plain, opposite in zip(weights, self.plain, self.opposite, strict=True):
            size, slices = abs(weight), plain if weight > 0 else opposite
            for shift in range(size.bit_length()):
                if size >> shift & 1:
                    for b, s in enumerate(slices):
                        put(shift + b, s)
        out, at = [], 0
        while at < len(waiting):
            terms = waiting[at]
            while len(terms) >= 3:
                a, b, c = terms.pop(), terms.pop(), terms.pop()
                half = a ^ b
                terms.append(half ^ c)
                half &= c
                a = a & b
                half |= a
                put(at + 1, half)
            if len(terms) == 2:
                a, b = terms
                put(at + 1, a & b)
                terms[:] = [a ^ b]
            out.append(terms[0] if terms else np.zeros_like(self.every))
            at += 1
        return out

    def top(self, weights: list[int], k: int, without: np.ndarray) -> np.ndarray:
        """Row numbers of the k largest sums, rows ``without`` left out; of ties the first rows."""
        sure, open_ = np.zeros_like(self.every), self.every.copy()
        for r in without:
            open_[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        if np.bitwise_count(open_).sum() <= k:
            return self._rows(open_)
        for s in reversed(self.score(weights)):
            ones = open_ & s
            n = int(np.bitwise_count(sure | ones).sum())
            if n >= k:
                open_ = ones
                if n == k:
                    break
            else:
                sure |= ones
                open_ &= ~s
        found = self._rows(sure)
        return np.concatenate([found, self._rows(open_)[: k - len(found)]])

    def _rows(self, bitmap: Bitmap) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.rows])


INDEX = "width int, block int, wide boolean, ids binary, least array<string>, counts array<int>, slices binary"


def _build(scale: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        wide = table.column("wide")[0].as_py()
        column, n = table.column("v"), len(table)
        if wide:
            values = np.array([quantised(v, scale) for v in column.to_pylist()], dtype=object).reshape(n, -1)
        else:
            flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False)
            values = np.floor(flat.astype(np.float64) * scale).astype(np.int64).reshape(n, -1)
        index = Slices.of(values)
        return pa.table(
            {
                "width": pa.array([values.shape[1]], pa.int32()),
                "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
                "wide": pa.array([wide], pa.bool_()),
                "ids": pa.array([table.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                "least": pa.array([[str(v) for v in index.least]], pa.list_(pa.string())),
                "counts": pa.array([index.counts], pa.list_(pa.int32())),
                "slices": pa.array([index.table.tobytes()], pa.binary()),
            }
        )

    return run


FOUND = "query_id long, vec_id long, exact string, score long"


def _search(k: int, scale: float):
    """Best rows of a block for each query; a block's rows of the index come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("width", "block", "chunk")), strict=True))
            ids_, queries = batch.column("ids"), batch.column("vec_id").to_pylist()
            for at, key in enumerate(keys):
                if key != now:
                    now, blocks = key, []
                if queries[at] is None:
                    least, counts, slices = (batch.column(c)[at].as_py() for c in ("least", "counts", "slices"))
                    ids = np.frombuffer(ids_[at].as_py(), dtype=np.int64)
                    blocks.append((ids, Slices(len(ids), [int(v) for v in least], counts, np.frombuffer(slices, dtype=np.uint64).reshape(sum(counts), -(-len(ids) // 64)))))
                    continue
                query, weights = queries[at], quantised(batch.column("v")[at].as_py(), scale)
                for ids, index in blocks:
                    own = np.arange(np.searchsorted(ids, query), np.searchsorted(ids, query, "right"))
                    found = index.top(weights, k, own)
                    # exact scores decide between blocks too, so those beyond a long keep their order
                    rows += [(query, int(i), s) for i, s in zip(ids[found].tolist(), index.scores(found, weights), strict=True)]
            if rows:
                columns = [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([_ordered(r[2]) for r in rows], pa.string()), pa.array([min(max(r[2], LEAST_LONG), MOST_LONG) for r in rows], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def _ordered(score: int) -> str | None:
    """A text that sorts like the integer, for scores beyond a long; null for others."""
    if LEAST_LONG < score < MOST_LONG:
        return None
    size = abs(score)
    digits = f"{len(str(size)):04d}{size}"
    return "1" + digits if score > 0 else "0" + "".join(chr(ord("9") - ord(c) + ord("0")) for c in digits)


def _usable(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    v = F.col(vector_col)
    # a difference with itself is 0 for finite numbers only
    finite = F.forall(v, lambda x: F.coalesce(x.cast("double") - x.cast("double") == 0.0, F.lit(False)))
    kept = df.where(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    return kept.withColumn("wide", F.exists("v", lambda x: F.abs(x) >= float(WIDE) / scale)).withColumn("width", F.size("v"))


def build_index(vectors: DataFrame, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The index, written once in the shared folder: see ``INDEX``; ids are sorted, 8 bytes each."""
    rows = _usable(vectors, id_col, vector_col, scale)
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(CELLS) / F.greatest("width", F.lit(1)))))
    sizes = stage(rows.groupBy("width").agg(F.count(F.lit(1)).alias("n")).select("width", F.ceil(F.col("n") / most).cast("int").alias("n_blocks")), "widths")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_WIDTHS else sizes
    dealt = rows.join(sizes, "width").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")).cast("int"))
    return stage(dealt.groupBy("width", "block", "wide").applyInArrow(_build(scale), INDEX), "bit-slices")


def search_index(index: DataFrame, queries: DataFrame, k: int = K, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows of an index."""
    asked = _usable(queries, id_col, vector_col, scale).select("vec_id", "v", "width")
    spark = index.sparkSession
    # a row for each length; queries of a length without vectors find nothing
    sizes = index.groupBy("width").agg((F.max("block") + 1).alias("n_blocks")).join(asked.groupBy("width").agg(F.count(F.lit(1)).alias("n")), "width")
    # as many parts of the queries of a block as use all cores where there are few blocks, however many queries there are
    total = F.sum("n_blocks").over(Window.partitionBy(F.lit(0)))
    parts = F.greatest(F.lit(1), F.least(F.ceil(F.col("n") / LEAST_CHUNK), F.ceil(F.lit(spark.sparkContext.defaultParallelism) / total)))
    sizes = stage(sizes.select("width", "n_blocks", parts.cast("int").alias("n_chunks")), "widths")
    few = sizes.count() <= BROADCAST_WIDTHS
    sizes = F.broadcast(sizes) if few else sizes

    def each(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    held = index.join(sizes, "width").select("width", "block", each("n_chunks").alias("chunk"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("v"), "ids", "least", "counts", "slices")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ids", "binary"), ("least", "array<string>"), ("counts", "array<int>"), ("slices", "binary"))]
    placed = asked.join(sizes, "width").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("n_chunks")).cast("int"))
    grid = held.unionByName(placed.select("width", each("n_blocks").alias("block"), "chunk", "vec_id", "v", *none))
    # the rows of the index have no id, so they come first
    streams = grid.repartition("width", "block", "chunk").sortWithinPartitions("width", "block", "chunk", F.asc_nulls_first("vec_id"))
    best = streams.mapInArrow(_search(k, scale), FOUND)
    # searched once: without this, a later recount would search again
    best = stage(best, "best-of-blocks")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("exact"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows. ``queries`` has the columns of ``vectors``."""
    return search_index(build_index(vectors, scale, id_col, vector_col), queries, k, scale, id_col, vector_col)


#: All rows whose id is divisible by 20 against all rows, in DuckDB's SQL.
SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.c, r.c) DESC, r.vec_id) AS INTEGER) AS rank,
  r.vec_id AS vec_id, CAST(list_inner_product(q.c, r.c) AS BIGINT) AS score
FROM v q JOIN v r ON r.vec_id <> q.vec_id AND len(q.c) = len(r.c) WHERE q.vec_id % 20 = 0
QUALIFY rank <= {K}
"""
