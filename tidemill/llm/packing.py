"""Packing: documents to fixed-length token sequences by shortest-pack-first over the length histogram.

1. One pass over the texts gives the ids of every document, cut into pieces of at most ``capacity`` ids,
   and numbers the pieces of each length inside their partition. The narrow piece table is written once.
2. The histogram of lengths (at most ``capacity`` rows, whatever the input) is placed on the driver, longest
   length first, each time into the pattern with most room. Only counts of equal patterns are kept.
3. Ranks inside a length (offset of the partition + number inside it) join the patterns back to the pieces.

Hot lengths need no sort and no single task: ranks come from counts per partition.

Defined results: a null text counts as empty (one piece, the end id alone); repeated rows each give their own
pieces; an empty table gives no rows; extra columns are ignored; a very long text is cut into many pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.tokens import byte_bpe, public_path
from tidemill.session import stage

CAPACITY = 2048
END_ID = 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, with ``part`` and ``nth`` (number of the piece among those of its length in its partition).

    The result must be written before use: ``part`` names the task that made a row.
    """
    path = tokenizer or public_path("byte_bpe_50k.json")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = byte_bpe(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.array([end_id], dtype="<u4")).astype("<u4", copy=False)
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    seen[len(piece)] += 1
                    rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, seen[len(piece)] - 1))
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                names = [c.split()[0] for c in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(pieces, PIECES)


def place(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int], int]]:
    """Shortest-pack-first over a histogram of lengths: ``(first sequence, lengths in order, count)`` of every pattern.

    Lengths go longest first; each goes to the pattern with most room, in one step for all equal packs.
    Where no pattern has room, new packs take as many of this length as fit. The work and the number of
    patterns depend on the number of distinct lengths, not on the number of documents.
    """
    room: dict[int, list[tuple[list[int], int]]] = {}
    done: list[tuple[list[int], int]] = []

    def put(pattern: list[int], space: int, count: int) -> None:
        if count:
            (room.setdefault(space, []) if space else done).append((pattern, count))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit a sequence of {capacity}")
        left = histogram[length]
        while left:
            space = max(room, default=0)
            if space < length:
                each = min(capacity // length, left)
                put([length] * each, capacity - each * length, left // each)
                left %= each
                continue
            pattern, count = room[space].pop()
            if not room[space]:
                del room[space]
            # all packs of the group take one; where there is more than enough, as many as leave them level with the next group
            used = min(count, left)
            put(pattern, space, count - used)
            put([*pattern, length], space - length, used)
            left -= used
    out, first = [], 0
    for pattern, count in [*done, *(x for s in sorted(room) for x in room[s])]:
        out.append((first, pattern, count))
        first += count
    return out


def rules(patterns: list[tuple[int, list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, rank_from, rank_to, sequence, in_one, offset)``: ranks of a length in [rank_from, rank_to) go to the pattern's sequences, ``in_one`` to each."""
    taken: dict[int, int] = {}
    out = []
    for first, pattern, count in patterns:
        at, offset = 0, 0
        while at < len(pattern):
            length = pattern[at]
            in_one = 1
            while at + in_one < len(pattern) and pattern[at + in_one] == length:
                in_one += 1
            start = taken.get(length, 0)
            taken[length] = start + count * in_one
            out.append((length, start, start + count * in_one, first, in_one, offset))
            offset += length * in_one
            at += in_one
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every row of a written piece table (``length``, ``part``, ``nth``) its ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("ranked_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # at most `capacity` rows come to the driver
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = spark.createDataFrame(rules(place(histogram, capacity)), "r_length long, rank_from long, rank_to long, first_sequence long, in_one long, first_offset long")
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("ranked_before") + F.col("nth"))
    # the rules depend on the number of distinct lengths alone, so their size is bounded by the capacity
    near = F.broadcast(placed)
    on = (F.col("length") == near["r_length"]) & (F.col("rank") >= near["rank_from"]) & (F.col("rank") < near["rank_to"])
    return (
        ranked.join(near, on)
        .withColumn("sequence_id", F.expr("first_sequence + (rank - rank_from) div in_one"))
        .withColumn("offset", F.expr("first_offset + (rank - rank_from) % in_one * length"))
        .drop("part", "nth", "ranked_before", "rank", "r_length", "rank_from", "rank_to", "first_sequence", "in_one", "first_offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(stage(cut_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces"), capacity)
