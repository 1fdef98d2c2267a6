"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact check, components.

1. One pass over the texts gives every document's number of distinct word shingles, the digest of its words and
   ``HASHES`` MinHash values: ``BANDS`` keys of ``ROWS`` values each, and the last byte of every value to compare.
   Documents with the same words form a class; one of them stands for it.
2. Representatives that agree in a band meet in a bucket. Each is paired with the smallest id
   of its buckets: a star, never all pairs of a bucket.
3. Candidate pairs are compared ``BATCH`` hash values at a time. After each batch a pair is dropped when the
   posterior chance that its similarity reaches the threshold (uniform prior) is under ``MISS``. Different values
   share their last byte with chance 1/256, which the threshold on matches takes in.
4. Survivors are verified on their full shingle sets, and the verified links give components.
5. Members of one bucket that are still in different components are compared in blocks (arrays of signatures
   inside a task, pairs of the bucket's largest component left out); survivors are verified exactly again. The
   first time only the best partners of each document are tried, and the second time all that are left. A pair is
   reported by the first band it shares only. So every colliding pair ends up in one component or was compared.

A pair at the threshold itself meets in no band with chance (1 - t**ROWS)**BANDS = 2e-5, and is dropped wrongly by
the batches with chance under 8 * MISS.

Defined results: a null or blank text has no shingles, is linked with nothing and kept; a text with fewer words
than a shingle has one shingle, its whole sequence; rows with the same id count as one document with all their
texts' links; a row without an id is always kept; an empty table gives no rows; extra columns are ignored; texts of any length are used whole.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.components import components
from tidemill.session import stage

WORDS = 5
THRESHOLD = 75  # per cent
BANDS, ROWS = 40, 5
HASHES, BATCH = 512, 64
MISS = 3e-5
#: Rows of one side of a block, and partners tried for each document the first time.
BLOCK, BEST = 4096, 4
#: Ids of colliding documents that are sent to every task, instead of shuffling all texts to pick theirs (16 bytes an id).
BROADCAST_IDS = 2_000_000
#: Words that are hashed together, distinct words whose hash a worker keeps, shingles that are min-hashed together.
CHUNK_WORDS, MEMO_WORDS, CHUNK_SHINGLES = 200_000, 400_000, 1 << 16

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


class _Hashes(dict):
    """Hash of a word, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_memo = _Hashes()


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8").lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def shingle_sets(docs: list[list[bytes]]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each list of words."""
    global _memo
    if len(_memo) > MEMO_WORDS:
        _memo = _Hashes()
    words = [w for d in docs for w in d]
    h = np.fromiter(map(_memo.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(len(h) - WORDS + 1, 0)
    s = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        s += (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29))) * _ODD[k]
    s = _mix(s)
    out, at = [], 0
    for d in docs:
        if len(d) >= WORDS:
            out.append(np.unique(s[at : at + len(d) - WORDS + 1]))
        elif d:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(d), seed=len(d))], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += len(d)
    return out


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """``HASHES`` MinHash values (uint32) of each non-empty set."""
    a, b = _permutations()
    out = np.empty((len(sets), HASHES), dtype=np.uint32)
    lo = 0
    while lo < len(sets):
        hi, held = lo + 1, len(sets[lo])
        while hi < len(sets) and held + len(sets[hi]) <= CHUNK_SHINGLES:
            held += len(sets[hi])
            hi += 1
        x = (np.concatenate(sets[lo:hi]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[lo : hi - 1])])
        y = np.empty_like(x)
        for k in range(HASHES):
            np.bitwise_xor(x, b[k], out=y)
            np.multiply(y, a[k], out=y)
            np.minimum.reduceat(y, starts, out=out[lo:hi, k])
        lo = hi
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key (int64) for each band of MinHash values."""
    rows = values[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.arange(BANDS, dtype=np.uint64) * _ODD[0] * np.ones((len(values), 1), dtype=np.uint64)
    for k in range(ROWS):
        keys = _mix(keys ^ (rows[:, :, k] * _ODD[k]))
    return keys.view(np.int64)


SIGNED = "doc_id long, n_shingles long, words binary, bands array<long>, sig binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(ids: list[int], docs: list[list[bytes]]) -> pa.RecordBatch:
        sets = shingle_sets(docs)
        full = [i for i, s in enumerate(sets) if len(s)]
        sig, words, bands = [None] * len(ids), [None] * len(ids), [None] * len(ids)
        if full:
            values = minhash([sets[i] for i in full])
            for i, row, keys in zip(full, values.astype(np.uint8), band_keys(values), strict=True):
                sig[i], bands[i], words[i] = row.tobytes(), keys, hashlib.blake2b(b" ".join(docs[i]), digest_size=16).digest()
        columns = [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(words, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "words", "bands", "sig"])

    for batch in batches:
        ids, docs, held = [], [], 0
        for i, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(i.as_py())
            docs.append(split_words(text.as_py()))
            held += len(docs[-1])
            if held >= CHUNK_WORDS:
                yield done(ids, docs)
                ids, docs, held = [], [], 0
        if ids:
            yield done(ids, docs)


@functools.cache
def least_matches(similarity: float, miss: float = MISS) -> list[int]:
    """For each batch: the fewest equal bytes of n with P(chance of a match >= that at ``similarity`` | matches) >= miss, prior uniform.

    The posterior is Beta(m + 1, n - m + 1), whose upper tail at t equals P(Binomial(n + 1, t) <= m).
    """
    threshold = similarity + (1 - similarity) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += np.exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * np.log(threshold) + (n + 1 - m) * np.log1p(-threshold))
        out.append(m)
    return out


def _bytes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, HASHES)


def _survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that no batch of hash values rules out."""
    least = least_matches(THRESHOLD / 100)
    for batch in batches:
        x, y = (_bytes(batch.column(c)) for c in (2, 3))
        alive, matches = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for k, m in enumerate(least):
            matches[alive] += (x[alive, k * BATCH : (k + 1) * BATCH] == y[alive, k * BATCH : (k + 1) * BATCH]).sum(axis=1)
            alive = alive[matches[alive] >= m]
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in (0, 1)], names=["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose full shingle sets are similar enough."""
    last: tuple = (None, None)
    for batch in batches:
        a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for i in range(len(a)):
            if last[0] != a[i]:
                last = (a[i], shingle_sets([split_words(batch.column(2)[i].as_py())])[0])
            x, y = last[1], shingle_sets([split_words(batch.column(3)[i].as_py())])[0]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both and 100 * both >= THRESHOLD * (len(x) + len(y) - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])


def _blocks(best: int | None):
    """Survivors between the outer members of a block (rows with ``outer``) and all its members of other components."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        least = least_matches(THRESHOLD / 100)
        band = key[1].as_py()
        ids, comp, role = (table.column(c).to_numpy() for c in ("id", "component", "role"))
        is_outer = table.column("is_outer").to_numpy().astype(bool)
        # a contiguous row for each hash, and for each band
        sig = np.ascontiguousarray(_bytes(table.column("sig")).T)
        keys = np.ascontiguousarray(np.array(table.column("bands").combine_chunks().values).reshape(-1, BANDS).T)
        inner, outer = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        one, two = [], []
        width = max(1, (1 << 20) // max(len(inner), 1))
        for lo in range(0, len(outer), width):
            o = outer[lo : lo + width]
            # the first batch compares whole columns of bytes: most pairs end here
            equal, first = np.empty((len(o), len(inner)), dtype=bool), np.zeros((len(o), len(inner)), dtype=np.uint8)
            for h in range(BATCH):
                np.equal(sig[h, o][:, None], sig[h, inner][None, :], out=equal)
                first += equal.view(np.uint8)
            # a pair of two outer members would turn up on both sides: the smaller id asks
            ask = (first >= least[0]) & (comp[o][:, None] != comp[inner][None, :]) & ((~is_outer[inner])[None, :] | (ids[o][:, None] < ids[inner][None, :]))
            at, to = np.nonzero(ask)
            i, j, matches = o[at], inner[to], first[at, to].astype(np.int64)
            for h in range(band):  # a pair that shares an earlier band is compared there
                apart = keys[h, i] != keys[h, j]
                i, j, matches = i[apart], j[apart], matches[apart]
            for k, m in enumerate(least[1:], 1):
                for h in range(k * BATCH, (k + 1) * BATCH):
                    matches += sig[h, i] == sig[h, j]
                alive = matches >= m
                i, j, matches = i[alive], j[alive], matches[alive]
            if best is not None and len(i):
                order = np.lexsort((ids[j], -matches, comp[j], i))
                i, j, matches = i[order], j[order], matches[order]
                new = np.r_[True, (i[1:] != i[:-1]) | (comp[j][1:] != comp[j][:-1])]
                start = np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
                top = np.arange(len(i)) - start < best
                i, j = i[top], j[top]
            one.append(ids[i])
            two.append(ids[j])
        x, y = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (one, two))
        return pa.table({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64())})

    return run


def _cross(members: DataFrame, parts: DataFrame, reps: DataFrame, best: int | None) -> DataFrame:
    """Surviving pairs between different components of one bucket."""
    inside = members.join(parts, members["id"] == parts["node"], "left").select("bucket", "band", "id", F.coalesce("component", "id").alias("component"))
    sizes = inside.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.max("n").alias("n_main")).where("k > 1")
    rows = inside.join(mixed, "bucket").join(reps, "id")
    rows = rows.withColumn("is_outer", (F.col("component") != F.col("main")).cast("int"))
    tall = F.ceil(F.col("n") / BLOCK).cast("int")
    wide = F.ceil((F.col("n") - F.col("n_main")) / BLOCK).cast("int")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int")
    # every member is once an inner row of its own chunk for each chunk of outer rows; outer rows also go to all chunks
    inner = rows.withColumn("role", F.lit(0)).withColumn("i", place % tall).withColumn("j", F.explode(F.sequence(F.lit(0), wide - 1)))
    outer = rows.where("is_outer = 1").withColumn("role", F.lit(1)).withColumn("j", place % wide).withColumn("i", F.explode(F.sequence(F.lit(0), tall - 1)))
    columns = ["bucket", "band", "i", "j", "id", "component", "is_outer", "role", "bands", "sig"]
    return inner.select(columns).unionByName(outer.select(columns)).groupBy("bucket", "band", "i", "j").applyInArrow(_blocks(best), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stage(docs.mapInArrow(_sign, SIGNED), "signed")
    classes = signed.where("words is not null").groupBy("words").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = stage(classes, "classes")
    reps = classes.select("id", "bands", "sig")
    banded = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("other")).where("hub < other").drop("other")
    members = stage(banded.join(shared, "bucket").select("bucket", "band", "id", "hub"), "members")
    wanted = stage(members.select(F.col("id").alias("doc_id")).distinct(), "wanted")
    if wanted.count() <= BROADCAST_IDS:  # a checked size
        wanted = F.broadcast(wanted)
    texts = stage(docs.join(wanted, "doc_id", "left_semi").dropDuplicates(), "texts")

    def signed_pairs(pairs: DataFrame) -> DataFrame:
        x, y = reps.select(F.col("id").alias("a"), F.col("sig").alias("x")), reps.select(F.col("id").alias("b"), F.col("sig").alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_survive, "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
        return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")

    stars = members.where("hub < id").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    parts = components(verified(stage(signed_pairs(stars), "survivors")))
    for best in (BEST, None):
        parts = stage(parts, "parts")
        pairs = stage(_cross(members, parts, reps, best), "survivors")
        links = verified(pairs)
        label = parts.select(F.col("node").alias("n1"), F.col("component").alias("c1")), parts.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        links = links.join(label[0], F.col("a") == F.col("n1"), "left").join(label[1], F.col("b") == F.col("n2"), "left").select(F.coalesce("c1", "a").alias("a"), F.coalesce("c2", "b").alias("b"))
        merged = stage(components(links), "merged").select(F.col("node").alias("component"), F.col("component").alias("top"))
        # components that merged, and nodes that were alone until now
        grown = parts.join(merged, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        alone = merged.join(parts, merged["component"] == parts["node"], "left_anti").select(F.col("component").alias("node"), F.col("top").alias("component"))
        parts = grown.union(alone)
    parts = stage(parts, "parts")
    found = signed.select("doc_id", "n_shingles", "words").join(classes.select("words", "id"), "words", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    own = F.coalesce("component", "id", "doc_id")
    return found.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
