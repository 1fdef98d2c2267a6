"""Periodic runs of words: suffix trees of a text and its reversal, constant-time common extensions, Lyndon roots.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST`` words and ``REPEATS`` periods long, that
no neighbouring word extends with that period.

1. Words become integers. A stretch can only hold a run where every word 4-gram has occurred at most a period before; the
   stretches of repeated 4-grams whose gaps are small against their length are cut out, with as many words in front as the
   longest period they allow. No run is lost or shortened by this: texts without a repeat end here.
2. Ukkonen's construction builds the suffix tree of each stretch and of its reversal. An Euler tour of each tree and minima
   over it (a sparse table over blocks of the tour, prefix and suffix minima in a block) give the depth of the lowest common
   ancestor of two leaves, so the longest common extension of two places to the right and, by the reversed tree, to the left.
3. The tree's leaves in the order of their words, and in the opposite order, give at each place the longest Lyndon word that
   begins there. For one of the two orders each run holds such a word whose length is its period (its Lyndon root). Each of
   these candidates is extended both ways by one look-up each; what is long enough is a run.

Texts are dealt by Spark; equal texts are worked on once where they meet in a batch. A task holds one batch of texts
and the trees of one stretch, some 400 bytes a word of it.

Defined results: a null, empty or blank text has no words and no runs; a text of fewer than ``LEAST`` words has no runs;
words are compared as bytes, case matters; rows with the same id, and with a null id, are each judged by their own text;
an empty table gives no rows; extra columns are ignored; texts of any length are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest words and fewest periods of a run, words of a screened gram (at most ``REPEATS`` for a gram to recur in each period).
LEAST, REPEATS, GRAM = 6, 4, 4
#: Words that are numbered and screened together.
CHUNK_WORDS = 200_000
#: Places of the Euler tour in one block of the table of minima.
TOUR_BLOCK = 16
WORD = r"[^\x20\x09-\x0D]+"
RUN = "array<struct<start:long,length:long,period:long>>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def suffix_tree(s: list[int]) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Ukkonen's suffix tree of ``s``, whose last item occurs nowhere else: first and end of each node's label, sorted edge keys and their children.

    An edge's key is node * (largest item + 1) + first item of its label; node 0 is the root.
    """
    n, width = len(s), max(s) + 1
    first, end, link, edges = [0], [0], [0], {}
    node = at = length = waiting = 0
    get = edges.get
    for i, c in enumerate(s):
        waiting += 1
        fresh = 0
        while waiting:
            if not length:
                at = i
            key = node * width + s[at]
            child = get(key)
            if child is None:
                edges[key] = len(first)
                first.append(i)
                end.append(n)
                link.append(0)
                if fresh:
                    link[fresh] = node
                fresh = 0
            else:
                begin = first[child]
                span = end[child] - begin
                if length >= span:
                    at += span
                    length -= span
                    node = child
                    continue
                if s[begin + length] == c:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                # the label is cut: what it had becomes a child of the new node
                middle = edges[key] = len(first)
                first += [begin, i]
                end += [begin + length, n]
                link += [0, 0]
                first[child] = begin + length
                edges[middle * width + s[begin + length]] = child
                edges[middle * width + c] = middle + 1
                if fresh:
                    link[fresh] = middle
                fresh = middle
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - waiting + 1
    keys = np.fromiter(edges.keys(), dtype=np.int64, count=len(edges))
    order = np.argsort(keys)
    return first, end, keys[order], np.fromiter(edges.values(), dtype=np.int64, count=len(edges))[order]


class Extensions:
    """Longest common extensions to the right in a list of items over 1, 2, ..., by its suffix tree; its suffixes in ascending order of items, and of opposite items."""

    def __init__(self, items: list[int], ordered: bool = True):
        n = self.n = len(items)
        s = [*items, 0]
        first, end, keys, children = suffix_tree(s)
        parents, width = keys // (max(s) + 1), max(s) + 1
        starts = np.searchsorted(parents, np.arange(len(first) + 1)).tolist()
        children, begins_with_end = children.tolist(), (keys % width == 0).tolist()
        tour: list[int] = []  # string depth at each step of the Euler tour
        place = [0] * (n + 1)  # where a suffix's leaf stands in it
        forward: list[int] = []  # suffixes in the order of the tour
        backward: list[int] = []
        stack = [(0, 0, 0)]
        # going down: a node is noted when it is met, and again after each of its children
        while stack:
            node, depth, turn = stack.pop()
            tour.append(depth)
            lo, hi = starts[node], starts[node + 1]
            if lo == hi:
                suffix = n + 1 - depth
                place[suffix] = len(tour) - 1
                forward.append(suffix)
            elif lo + turn < hi:
                child = children[lo + turn]
                stack.append((node, depth, turn + 1))
                stack.append((child, depth + end[child] - first[child], 0))
        # the opposite order of words; the end of the text still comes first
        stack = [(0, 0)] if ordered else []
        while stack:
            node, depth = stack.pop()
            lo, hi = starts[node], starts[node + 1]
            if lo == hi:
                backward.append(n + 1 - depth)
            else:
                below = children[lo:hi]
                if begins_with_end[lo]:
                    below = [*below[1:], below[0]]  # popped first
                stack += [(c, depth + end[c] - first[c]) for c in below]
        self.place = np.array(place, dtype=np.int64)
        self.orders = forward, backward
        self._minima(np.array(tour, dtype=np.int32))

    def _minima(self, tour: np.ndarray) -> None:
        blocks = -(-len(tour) // TOUR_BLOCK)
        padded = np.full(blocks * TOUR_BLOCK, np.iinfo(np.int32).max, dtype=np.int32)
        padded[: len(tour)] = tour
        rows = padded.reshape(blocks, TOUR_BLOCK)
        self.tour = padded
        self.before = np.minimum.accumulate(rows, axis=1).ravel()
        self.after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [rows.min(axis=1)]
        step = 1
        while 2 * step <= blocks:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items are equal from i and from j on, for i != j, both from 0 to n."""
        x, y = self.place[i], self.place[j]
        x, y = np.minimum(x, y), np.maximum(x, y)
        bx, by = x // TOUR_BLOCK, y // TOUR_BLOCK
        out = np.minimum(self.after[x], self.before[y])
        between = by - bx - 1
        wide = np.flatnonzero(between > 0)
        if len(wide):
            level = np.frexp(between[wide].astype(np.float64))[1] - 1
            for k in np.unique(level):
                w = wide[level == k]
                out[w] = np.minimum(out[w], np.minimum(self.table[k][bx[w] + 1], self.table[k][by[w] - (1 << k)]))
        same = np.flatnonzero(bx == by)
        if len(same):
            a, b = x[same], y[same]
            least = self.tour[a]
            for k in range(1, TOUR_BLOCK):
                least = np.minimum(least, self.tour[np.minimum(a + k, b)])
            out[same] = least
        return out.astype(np.int64)


def lyndon_lengths(order: list[int]) -> np.ndarray:
    """Length of the longest Lyndon word at each place, from the suffixes in ascending order (the empty one first): up to the next smaller suffix."""
    n = len(order) - 1
    rank = [0] * (n + 1)
    for r, suffix in enumerate(order):
        rank[suffix] = r
    out, following = [0] * n, [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        j, r = i + 1, rank[i]
        while rank[j] > r:
            j = following[j]
        following[i] = j
        out[i] = j - i
    return np.array(out, dtype=np.int64)


def stretch_runs(items: list[int], least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of items 1, 2, ..., in order."""
    n = len(items)
    if n < least:
        return []
    right, left = Extensions(items), Extensions(items[::-1], ordered=False)
    found = []
    for order in right.orders:
        lengths = lyndon_lengths(order)
        at = np.flatnonzero(lengths * repeats <= n)
        p = lengths[at]
        ahead = right.common(at, at + p)
        # words in front: the suffix of the reversed text that begins just before a place
        behind = left.common(n - at, n - at - p)
        start, stop = at - behind, at + p + ahead
        good = (stop - start >= least) & (stop - start >= repeats * p)
        found.append(np.stack([start[good], (stop - start)[good], p[good]], axis=1))
    return [tuple(r) for r in np.unique(np.concatenate(found), axis=0).tolist()]


def _repeated(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Distance of each word 4-gram to the one before that equals it in the same text (0: none), by 64-bit hashes."""
    n = len(words) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    h = doc[:n].astype(np.uint64)
    for k in range(GRAM):
        h = (h ^ (h >> np.uint64(29))) * _MIX + words[k : k + n].astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * _MIX
    order = np.argsort(h, kind="stable")
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    gap = np.zeros(n, dtype=np.int64)
    gap[order[1:][same]] = order[1:][same] - order[:-1][same]
    gap[doc[:n] != doc[GRAM - 1 :]] = 0  # a gram over the end of a text
    return gap


def stretches(gap: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int]]:
    """Stretches (from, to) of words that may hold runs, from the gaps of their grams; overlapping ones are one."""
    # a run of period q has gaps up to q at (repeats - 1) * q - GRAM + 1 places in a row, and at ``least`` - q - GRAM + 1
    some = max(min(max((repeats - 1) * q, least - q) for q in range(1, least + 1)) - GRAM + 1, 1)
    edge = np.flatnonzero(np.diff(np.r_[False, gap > 0, False].astype(np.int8)))
    out: list[list[int]] = []
    for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        todo = [(lo, hi)]
        while todo:
            x, y = todo.pop()
            if y - x < some:
                continue
            longest = (y - x + GRAM - 1) // (repeats - 1)  # period of any run in here
            far = np.flatnonzero(gap[x:y] > longest)
            if len(far):
                todo += zip([x, *(x + far + 1).tolist()], [*(x + far).tolist(), y], strict=True)
            else:
                out.append([x - max(longest, least), y + GRAM - 1])
    merged: list[list[int]] = []
    for x, y in sorted(out):
        if merged and x <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], y)
        else:
            merged.append([x, y])
    return [(x, y) for x, y in merged]


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    ids: dict[bytes, int] = {}
    words = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), dtype=np.int64, count=int(lengths.sum()))
    doc = np.repeat(np.arange(len(texts)), lengths)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    spans: dict[int, list[list[int]]] = {}
    for x, y in stretches(_repeated(words, doc)):
        # a stretch lies in the text of its last word, but for the words in front of it
        for d in range(int(doc[max(x, 0)]), int(doc[y - 1]) + 1):
            lo, hi = max(x, int(starts[d])), min(y, int(starts[d] + lengths[d]))
            if hi - lo >= LEAST:
                spans.setdefault(d, []).append([lo, hi])
    for d, parts in spans.items():
        for lo, hi in parts:
            _, items = np.unique(words[lo:hi], return_inverse=True)
            out[d] += [(lo - int(starts[d]) + s, n, p) for s, n, p in stretch_runs((items + 1).tolist())]
        out[d].sort(key=lambda r: (r[0], r[2]))
    return out


FOUND = f"n_words long, runs {RUN}, collapsed string"


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that are in no run after its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inner = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def done(keys: list[pa.Array], texts: list[list[bytes]]) -> pa.RecordBatch:
        seen: dict[bytes, int] = {}
        which = [seen.setdefault(b" ".join(t), len(seen)) for t in texts]
        distinct = [k.split() for k in seen]
        runs = runs_of(distinct)
        short = [_collapse(t, r) for t, r in zip(distinct, runs, strict=True)]
        columns = [
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([[{"start": s, "length": n, "period": p} for s, n, p in runs[w]] for w in which], inner),
            pa.array([short[w] for w in which], pa.binary()).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *columns], names=["id", "n_words", "runs", "collapsed"])

    for batch in batches:
        texts, held, lo = [], 0, 0
        for k, text in enumerate(batch.column(1)):
            texts.append((text.as_py() or "").encode("utf-8").split())
            held += len(texts[-1])
            if held >= CHUNK_WORDS:
                yield done([batch.column(0).slice(lo, k + 1 - lo)], texts)
                texts, held, lo = [], 0, k + 1
        if texts:
            yield done([batch.column(0).slice(lo)], texts)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, ``n_words``, ``runs`` (start, length and period, by start, then period) and ``collapsed`` (the words in no run after its first period)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(_find, f"id {kind}, {FOUND}").withColumnRenamed("id", id_col)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: where a digest of the id says so (every tenth id), the text's words from one place on repeat a first few. A null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    n, g = F.col("n"), F.col("g")
    placed = split.withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    a, p = F.col("a"), F.col("p")
    again = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return placed.select("doc_id", F.when(F.col("words").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the one of greatest exact exponent, and digests of all runs and of what is left without their repeats."""
    # lengths and periods are ints, so products of two are exact
    better = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"]) | ((x["length"] * y["period"] == y["length"] * x["period"]) & (F.struct(x["start"], x["period"]) < F.struct(y["start"], y["period"])))
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda top, r: F.when(top.isNull() | better(r, top), r).otherwise(top))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
