"""Hard negatives by threshold joins in the manner of L2AP: a partial inverted index, partial scores, falling thresholds.

An anchor's positives are its best rows of the same label. For each of them the first rows of other labels are wanted whose
score lies in a window below the positive's: from ``LEAST`` to ``MOST`` per cent of it.

Both searches are one join with a threshold for each anchor, run in rounds. A round returns an anchor's best rows that
reach its threshold; anchors whose windows are not full go into the next round with a lower one, down to what covers the
whole window. So most rows are never scored in full:

1. The index deals rows of one length to blocks by a hash of their id and is written once. A block takes its dimensions in
   order of their squares' sums, in groups of ``GROUP``.
2. For a batch of anchors a row is listed under a group of dimensions only while the norm of what is left of it from there
   on can still reach the least threshold (its suffix norm times the anchor's norm). The rows of a group are a prefix of
   the block in order of where their lists end. Rows that are listed nowhere cannot qualify.
3. Scores accumulate group by group. A pair is dropped once its partial score plus the product of the norms that remain
   is under the threshold; when few are left they go on as pairs. Dimensions that the index left out are added at the end.

Components become floor(scale * x); scores are exact integers. Vectors whose sums a double may not hold exactly are kept in
blocks of their own and scored in full with Python integers. What leaves a task is at most ``K`` rows for each anchor (window) and block. Blocks times
chunks of anchors are the groups of a grid; a stated set of anchors against all rows.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; empty vectors
score 0 with each other; vectors of different lengths never meet; rows of one id are separate candidates and none is a
candidate of an anchor with that id; an anchor row that repeats as a whole counts once, ones that share only the id are
anchors each; ties go to the smaller id; a negative positive score has an empty window; a score beyond the range of a long is
ranked exactly and shown as that range's end; an empty table or no anchor gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.topk import LEAST_LONG, MOST_LONG, quantised
from tidemill.session import stage

K, SCALE = 5, 256
#: Ends of a positive's window, per cent of its score.
LEAST, MOST = 80, 100
#: Components of a block at most, rows of a block at most, anchors of a chunk at most; dimensions of a group; anchors scored together.
CELLS, BLOCK, CHUNK, GROUP, BATCH = 1 << 22, 1 << 16, 1 << 14, 8, 64
#: Rows of a block at least, where there are fewer blocks than cores.
LEAST_BLOCK = 1024
#: Falling thresholds: of the product of the largest norms for positives (None: all rows), per cent of the way down the window for negatives.
POSITIVE_STEPS: tuple[float | None, ...] = (0.5, 0.25, 0.0, None)
NEGATIVE_STEPS: tuple[int, ...] = (20, 60, 100)
#: Quantised components from here on, and vectors of more components, are summed as Python integers; products of others sum to less than 2**50.
WIDE, LONGEST = 1 << 18, 1 << 14
#: Pairs go on one by one once fewer than one in so many are left.
FEW = 16
#: Different lengths of vectors, a row each, that are sent to every task; with more of them rows are shuffled by length.
BROADCAST_WIDTHS = 100_000

INDEX = "width int, block int, ids binary, labels array<string>, cells binary, wide array<string>"


def _text(score: int) -> str:
    """A text that sorts like the integer."""
    size = str(abs(score))
    digits = f"{len(size):04d}{size}"
    return "1" + digits if score >= 0 else "0" + "".join(chr(ord("9") + ord("0") - ord(c)) for c in digits)


def _number(text: str) -> int:
    return int(text[5:]) if text[0] == "1" else -int("".join(chr(ord("9") + ord("0") - ord(c)) for c in text[5:]))


class Block:
    """Rows of one block: a (rows, dimensions) array of integers, of Python integers where its type is object."""

    def __init__(self, values: np.ndarray):
        self.exact, (self.n, width) = values.dtype == object, values.shape
        if self.exact:
            self.values = values
            return
        squares = np.square(values, dtype=np.float64)
        self.order = np.argsort(-squares.sum(axis=0), kind="stable")
        self.groups = [(lo, min(lo + GROUP, width)) for lo in range(0, width, GROUP)]
        self.values = np.ascontiguousarray(values[:, self.order].T, dtype=np.float64)
        self.norms = _suffix_norms(squares[:, self.order], self.groups)

    def reaching(self, queries: list[list[int]], least: list[int | None], may: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(query, row, score) of the pairs in ``may`` whose score is at least the query's threshold (None: all of them)."""
        if self.exact or any(abs(x) >= WIDE for q in queries for x in q):
            rows = self.values if self.exact else self.values[np.argsort(self.order)].T
            out = []
            for i, (q, t) in enumerate(zip(queries, least, strict=True)):
                for j in np.flatnonzero(may[i]).tolist():
                    s = sum(x * int(y) for x, y in zip(q, rows[j], strict=True))
                    if t is None or s >= t:
                        out.append((i, j, s))
            return np.array([r[0] for r in out], dtype=np.int64), np.array([r[1] for r in out], dtype=np.int64), [r[2] for r in out]
        q = np.array(queries, dtype=np.float64).reshape(len(queries), -1)[:, self.order]
        norms, bound = _suffix_norms(np.square(q), self.groups), np.array([-np.inf if t is None else float(t) for t in least])
        # the index: under how many groups of dimensions each row is listed, for the least demanding of these anchors;
        # all bounds are looser by one, more than doubles err below 2**50
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.min(np.where(bound - 1 <= 0, 0.0, (bound - 1) / norms[0]), initial=np.inf)
        listed = (self.norms[:-1] >= reach).sum(axis=0)
        by = np.argsort(-listed, kind="stable")
        ends = [int((listed > g).sum()) for g in range(len(self.groups))]
        values, left, may = self.values[:, by], self.norms[:, by], may[:, by]
        total, pairs = np.zeros(may.shape), None
        if self.groups:
            may[:, ends[0] :] = False
        for g, (lo, hi) in enumerate(self.groups):
            n = ends[g]
            if pairs is None:
                total[:, :n] += q[:, lo:hi] @ values[lo:hi, :n]
                may[:, :n] &= total[:, :n] + norms[g + 1][:, None] * left[g + 1, :n] + 1 >= bound[:, None]
                if np.count_nonzero(may) * FEW < may.size:
                    pairs = np.nonzero(may)
            else:
                i, j = pairs
                here = j < n
                total[i[here], j[here]] += np.einsum("pd,dp->p", q[i[here], lo:hi], values[lo:hi, j[here]])
                keep = ~here | (total[i, j] + norms[g + 1, i] * left[g + 1, j] + 1 >= bound[i])
                pairs = i[keep], j[keep]
        i, j = np.nonzero(may) if pairs is None else pairs
        for g, (lo, hi) in enumerate(self.groups):  # what the index left out
            out = j >= ends[g]
            total[i[out], j[out]] += np.einsum("pd,dp->p", q[i[out], lo:hi], values[lo:hi, j[out]])
        keep = total[i, j] >= bound[i]
        i, j = i[keep], j[keep]
        return i, by[j], total[i, j].astype(np.int64).tolist()


def _suffix_norms(squares: np.ndarray, groups: list[tuple[int, int]]) -> np.ndarray:
    """(groups + 1, rows): the norm of what is left of each row from a group of dimensions on."""
    out = np.zeros((len(groups) + 1, len(squares)))
    for g in range(len(groups) - 1, -1, -1):
        lo, hi = groups[g]
        out[g] = out[g + 1] + squares[:, lo:hi].sum(axis=1)
    return np.sqrt(out)


def _build(scale: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        vectors, is_wide = table.column("v").to_pylist(), table.column("is_wide")[0].as_py()
        width, cells, wide = len(vectors[0]), None, None
        if is_wide:
            wide = [" ".join(map(str, quantised(v, scale))) for v in vectors]
        else:
            cells = np.floor(np.array(vectors, dtype=np.float64) * scale).astype(np.int32)
            cells = cells.astype(np.int16) if len(cells) and np.abs(cells).max(initial=0) < 1 << 15 else cells
            cells = bytes([cells.itemsize]) + cells.tobytes()
        ids = table.column("vec_id").to_numpy().astype(np.int64).tobytes()
        columns = {"width": pa.array([width], pa.int32()), "block": pa.array([table.column("block")[0].as_py()], pa.int32()), "ids": pa.array([ids], pa.binary())}
        return pa.table(columns | {"labels": pa.array([table.column("label").to_pylist()], pa.list_(pa.string())), "cells": pa.array([cells], pa.binary()), "wide": pa.array([wide], pa.list_(pa.string()))})

    return run


FOUND = "anchor long, top string, vec_id long, score string"


def _search(k: int, scale: float, least: int, most: int, step: int | None):
    """Best rows of a block for each anchor (``step`` None) or for each of its windows, down to ``step`` per cent of them."""

    def bottom(top: int) -> tuple[int, int, int]:
        hi, lo = most * top // 100, -(-least * top // 100)
        return hi, lo, hi - (hi - lo) * step // 100

    def run(table: pa.Table) -> pa.Table:
        is_query = np.array([v is None for v in table.column("ids").to_pylist()], dtype=bool)
        blocks, queries = table.filter(pa.array(~is_query)).to_pylist(), table.filter(pa.array(is_query)).to_pylist()
        found: list[tuple[int, str | None, int, int]] = []
        for b in blocks if queries else []:
            ids, codes = np.frombuffer(b["ids"], dtype=np.int64), {}
            labels = np.array([codes.setdefault(x, len(codes)) for x in b["labels"]], dtype=np.int64)
            if b["cells"] is None:
                values = np.array([[int(x) for x in row.split()] for row in b["wide"]], dtype=object).reshape(len(ids), b["width"])
            else:
                values = np.frombuffer(b["cells"], dtype=f"i{b['cells'][0]}", offset=1).reshape(len(ids), b["width"])
            block = Block(values)
            for at in range(0, len(queries), BATCH):
                asked = queries[at : at + BATCH]
                same = np.array([codes.get(q["label"], -1) for q in asked])[:, None] == labels[None, :]
                other = np.array([q["vec_id"] for q in asked])[:, None] != ids[None, :]
                windows = [[(t, *bottom(_number(t))) for t in q["tops"] or ()] for q in asked]
                bounds = [q["least"] if step is None else min(w[3] for w in own) for q, own in zip(asked, windows, strict=True)]
                i, j, scores = block.reaching([quantised(q["v"], scale) for q in asked], bounds, (same if step is None else ~same) & other)
                by: dict[int, list[tuple[int, int]]] = {}
                for x, y, s in zip(i.tolist(), ids[j].tolist(), scores, strict=True):
                    by.setdefault(x, []).append((-s, y))
                for x, pairs in by.items():
                    pairs.sort()
                    key = asked[x]["anchor"]
                    if step is None:
                        found += [(key, None, y, -s) for s, y in pairs[:k]]
                    for top, hi, _, to in windows[x]:
                        first = bisect.bisect_left(pairs, (-hi, LEAST_LONG))
                        found += [(key, top, y, -s) for s, y in pairs[first : first + k] if -s >= to]
        columns = zip(*found, strict=True) if found else ([], [], [], [])
        anchor, top, vec_id, score = columns
        return pa.table({"anchor": pa.array(anchor, pa.int64()), "top": pa.array(top, pa.string()), "vec_id": pa.array(vec_id, pa.int64()), "score": pa.array([_text(s) for s in score], pa.string())})

    return run


class Rows:
    """The rows that take part, and the index over them."""

    def __init__(self, vectors: DataFrame, scale: float, id_col: str, vector_col: str, label_col: str):
        v = F.col(vector_col)
        # a difference with itself is 0 for finite numbers only
        finite = F.forall(v, lambda x: F.coalesce(x.cast("double") - x.cast("double") == 0.0, F.lit(False)))
        kept = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & finite)
        kept = kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.cast("array<double>").alias("v"))
        is_wide = F.exists("v", lambda x: F.abs(x) >= float(WIDE - 1) / scale) | (F.size("v") > LONGEST)
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x * scale) * (x * scale)))
        self.rows, self.scale = kept.withColumns({"is_wide": is_wide, "width": F.size("v"), "norm": norm}), scale
        cores = vectors.sparkSession.sparkContext.defaultParallelism

        def blocks(n: str):
            most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(CELLS) / F.greatest("width", F.lit(1)))))
            return F.greatest(F.ceil(F.col(n) / most), F.least(F.lit(cores), F.ceil(F.col(n) / LEAST_BLOCK))).cast("int")

        counted = self.rows.groupBy("width").agg(F.count_if(~F.col("is_wide")).alias("narrow"), F.count_if("is_wide").alias("broad"), F.max("norm").alias("most"))
        self.widths = stage(counted.select("width", blocks("narrow").alias("n_narrow"), blocks("broad").alias("n_broad"), "most"), "widths")
        self.few_widths = self.widths.count() <= BROADCAST_WIDTHS
        h = F.xxhash64("vec_id")
        block = F.when(F.col("is_wide"), F.col("n_narrow") + F.pmod(h, F.col("n_broad"))).otherwise(F.pmod(h, F.col("n_narrow"))).cast("int")
        dealt = self.sized(self.rows).select("width", block.alias("block"), "vec_id", "label", "v", "is_wide")
        self.index = stage(dealt.groupBy("width", "block").applyInArrow(_build(scale), INDEX), "partial-index")

    def sized(self, df: DataFrame) -> DataFrame:
        """With what is known of the rows of the same length."""
        return df.join(F.broadcast(self.widths) if self.few_widths else self.widths, "width")

    def best(self, asked: DataFrame, k: int, least: int, most: int, step: int | None) -> DataFrame:
        """``anchor, top, vec_id, score, rank``: the k best rows that reach the thresholds. ``asked``: anchor, vec_id, label, v, width, least, tops."""
        columns = ["anchor", "vec_id", "label", "v", "least", "tops"]
        chunks = asked.groupBy("width").agg(F.count(F.lit(1)).alias("n"))
        size = F.greatest(F.lit(1), F.least(F.lit(CHUNK), F.floor(F.lit(CELLS) / F.greatest("width", F.lit(1)))))
        chunks = stage(chunks.select("width", F.ceil(F.col("n") / size).cast("int").alias("n_chunks")), "chunks")
        chunks = F.broadcast(chunks) if self.few_widths else chunks
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        none = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in columns]
        held = self.index.join(chunks, "width").select("width", "block", each("n_chunks").alias("chunk"), "ids", "labels", "cells", "wide", *none)
        placed = self.sized(asked.join(chunks, "width")).withColumn("n_blocks", F.col("n_narrow") + F.col("n_broad"))
        placed = placed.select("width", each("n_blocks").alias("block"), F.pmod(F.xxhash64("anchor"), F.col("n_chunks")).cast("int").alias("chunk"), *(F.lit(None).cast(self.index.schema[c].dataType).alias(c) for c in ("ids", "labels", "cells", "wide")), *columns)
        found = held.unionByName(placed).groupBy("width", "block", "chunk").applyInArrow(_search(k, self.scale, least, most, step), FOUND)
        order = Window.partitionBy("anchor", "top").orderBy(F.desc("score"), "vec_id")
        return stage(found, "best-of-blocks").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: str, k_positives: int = K, k: int = K, scale: float = SCALE, least: int = LEAST, most: int = MOST, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. ``anchors`` is an SQL condition on the rows ``vec_id, label, v``."""
    rows = Rows(vectors, scale, id_col, vector_col, label_col)
    mine = rows.rows.where(anchors).select(F.xxhash64("vec_id", "label", "v").alias("anchor"), "vec_id", "label", "v", "width", "norm").dropDuplicates(["anchor"])
    mine = stage(mine, "anchors")
    waiting, positives = mine, None
    for step in POSITIVE_STEPS:
        # any threshold is right; one that a long cannot hold is none
        limit = F.lit(None).cast("long")
        if step is not None:
            product = F.floor(F.lit(float(step)) * F.col("norm") * F.col("most"))
            limit = F.when(F.abs(product) < float(1 << 50), product.cast("long"))
        asked = rows.sized(waiting).select("anchor", "vec_id", "label", "v", "width", limit.alias("least"), F.lit(None).cast("array<string>").alias("tops"))
        found = stage(rows.best(asked, k_positives, least, most, None), "positives")
        if step is not None:
            full = found.where(F.col("rank") == k_positives).select("anchor")
            found = found.join(full, "anchor", "left_semi")
            waiting = stage(waiting.join(full, "anchor", "left_anti"), "waiting")
        positives = found if positives is None else positives.unionByName(found)
        if step is None or waiting.isEmpty():
            break
    # a window for each different score that is not negative
    positives = stage(positives.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("top")), "positives")
    open_ = stage(positives.where("top >= '1'").select("anchor", "top").distinct(), "windows")
    negatives = None
    for step in NEGATIVE_STEPS:
        tops = open_.groupBy("anchor").agg(F.collect_list("top").alias("tops"))  # k_positives at most
        asked = mine.join(tops, "anchor").select("anchor", "vec_id", "label", "v", "width", F.lit(None).cast("long").alias("least"), "tops")
        found = stage(rows.best(asked, k, least, most, step), "negatives")
        if step < 100:
            full = found.where(F.col("rank") == k).select("anchor", "top")
            found = found.join(full, ["anchor", "top"], "left_semi")
            open_ = stage(open_.join(full, ["anchor", "top"], "left_anti"), "windows")
        negatives = found if negatives is None else negatives.unionByName(found)
        if step == 100 or open_.isEmpty():
            break
    shown = positives.join(negatives.select("anchor", "top", "rank", F.col("vec_id").alias("negative_id"), "score"), ["anchor", "top"]).join(mine.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return shown.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", _long(F.col("top")).alias("positive_score"), _long(F.col("score")).alias("negative_score"))


def _long(text: Column) -> Column:
    """The number of a sortable text, as far as a long holds it."""
    up, digits = F.substring(text, 1, 1) == "1", F.substring(text, 6, 1 << 14)
    plain = F.when(up, digits).otherwise(F.concat(F.lit("-"), F.translate(digits, "0123456789", "9876543210")))
    return F.coalesce(plain.try_cast("long"), F.when(up, F.lit(MOST_LONG)).otherwise(F.lit(LEAST_LONG)))


#: The same in DuckDB's SQL, all pairs of anchors and rows.
SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same, CAST(list_inner_product(a.c, r.c) AS BIGINT) AS score
  FROM v a JOIN v r ON r.vec_id <> a.vec_id AND len(a.c) = len(r.c) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {K})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND {LEAST} * positive_score <= 100 * s.score AND 100 * s.score <= {MOST} * positive_score
QUALIFY rank <= {K}
"""
