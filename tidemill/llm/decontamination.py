"""Benchmark passages in documents: winnowed fingerprints of word windows, joined with those of the benchmark and extended to spans.

A window is ``WINDOW`` consecutive words of a benchmark item, or the whole item where it has fewer. A document's word is hit
where it lies in an occurrence of any window.

1. Winnowing: of the ``WINDOW - GRAM + 1`` hashes of word ``GRAM``-grams that a window covers the smallest is kept. Equal
   windows keep equal hashes, so every shared span of ``WINDOW`` words shares a fingerprint. Items of fewer words are too short
   for that guarantee; their own grams of that length are fingerprints.
2. One pass over the documents keeps the places whose fingerprint the benchmark may have. That is looked up in a bitmap of
   2**``BITS`` bits (4 MB, whatever the number of items) sent to every task; a fuller bitmap only lets more places pass. A
   place that passes gets a 128-bit digest of the window's words. Equal texts with such places form a class.
3. Places and benchmark windows are joined on fingerprint and digest. Hits of overlapping windows extend each other to spans,
   whose words are counted.
4. Windows that occur in the same items share a key of that set of items, so a document meets a set once and not every
   window of it, and each set is spelled out once per class of texts.

Defined results: a null or wordless text has no words, hits or items; an item without words is never found; an item without
an id makes hits and is in no list; repeated item ids are one item with all their windows; rows of documents are judged each,
whatever their ids; an empty benchmark hits nothing; an empty table of documents gives no rows; extra columns are ignored;
texts of any length are read whole. The list of a document's items is part of its row, as long as the result asks for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import stage

#: Words of a window and of a winnowed gram.
WINDOW, GRAM = 10, 5
#: Bits of the bitmap of fingerprints, as a power of two.
BITS = 25
#: Benchmark windows, or classes of texts with hits, that are sent to every task (some 60 bytes each); with more of them both sides are shuffled.
BROADCAST_WINDOWS = 500_000
#: Words that are hashed together, and distinct words whose hash a worker keeps.
CHUNK_WORDS, MEMO_WORDS = 200_000, 400_000

_LETTERS = bytes(c if chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(128)) + bytes(range(128, 256))
_ODD = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(WINDOW)]


class _Hashes(dict):
    """Hash of a word, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_memo = _Hashes()


def split_words(text: str | None) -> list[bytes]:
    """Stretches of ASCII digits and letters (A-Z lower-cased) and of characters beyond ASCII."""
    return (text or "").encode("utf-8").translate(_LETTERS).split()


def _grams(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the words from each place on, ``length`` of them."""
    n = max(len(h) - length + 1, 0)
    s = np.full(n, length, dtype=np.uint64)
    for k in range(length):
        s += (h[k : k + n] ^ (h[k : k + n] >> np.uint64(31))) * _ODD[k]
    s ^= s >> np.uint64(29)
    s *= _ODD[1]
    s ^= s >> np.uint64(32)
    return s


def fingerprints(h: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` words its fingerprint: the least gram's hash, or the hash of all words of a short one."""
    if length < WINDOW:
        return _grams(h, length)
    least = _grams(h, GRAM)
    covered, width = WINDOW - GRAM + 1, 1
    while 2 * width <= covered:
        least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
        width *= 2
    rest = covered - width
    return np.minimum(least[:-rest], least[rest:]) if 0 < rest < len(least) else least if not rest else least[:0]


def _hashed(texts: list[list[bytes]]) -> np.ndarray:
    global _memo
    if len(_memo) > MEMO_WORDS:
        _memo = _Hashes()
    words = [w for t in texts for w in t]
    return np.fromiter(map(_memo.__getitem__, words), dtype=np.uint64, count=len(words))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of each item: item, its number of words, fingerprint, digest."""
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = split_words(text)
            length = min(len(words), WINDOW)
            if words:
                found = fingerprints(_hashed([words]), length)
                digests = [_digest(words[i : i + length]) for i in range(len(found))]
                columns = [pa.array([item] * len(found), pa.string()), pa.array([length] * len(found), pa.int32()), pa.array(found.view(np.int64), pa.int64()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "len", "fp", "digest"])


PLACES = "n_words long, words binary, start array<int>, len array<int>, fp array<long>, digest array<binary>"


def _places(bitmap: np.ndarray, lengths: list[int]):
    """Per document its places whose fingerprint is in the bitmap."""
    mask = np.uint64((1 << BITS) - 1)

    def done(keys: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        h, sizes = _hashed(texts), np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(texts)), sizes)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for length in lengths:
            fp = fingerprints(h, length)
            n = len(fp)
            at = fp & mask
            met = (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            for i in np.flatnonzero(met.astype(bool) & (doc[:n] == doc[length - 1 : length - 1 + n])).tolist():
                d = int(doc[i])
                found.setdefault(d, []).append((i - int(starts[d]), length, int(fp[i].view(np.int64))))
        places = [found.get(d) for d in range(len(texts))]
        columns = [
            pa.array(sizes, pa.int64()),
            pa.array([p and _digest(t) for p, t in zip(places, texts, strict=True)], pa.binary()),
            *(pa.array([p and [x[k] for x in p] for p in places], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int64()))),
            pa.array([p and [_digest(t[i : i + n]) for i, n, _ in p] for p, t in zip(places, texts, strict=True)], pa.list_(pa.binary())),
        ]
        return pa.RecordBatch.from_arrays([keys, *columns], names=["id", "n_words", "words", "start", "len", "fp", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held, lo = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                texts.append(split_words(text.as_py()))
                held += len(texts[-1])
                if held >= CHUNK_WORDS:
                    yield done(batch.column(0).slice(lo, k + 1 - lo), texts)
                    texts, held, lo = [], 0, k + 1
            if texts:
                yield done(batch.column(0).slice(lo), texts)

    return run


def bitmap_of(windows: DataFrame) -> np.ndarray:
    """The bitmap of all fingerprints: at most 2**(BITS - 6) words of 64 bits come to the driver, however many windows there are."""
    at = F.col("fp").bitwiseAND((1 << BITS) - 1)
    rows = windows.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST((fp & {(1 << BITS) - 1}) & 63 AS INT))")).alias("bits"))
    out = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    found = rows.toArrow()
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, len, fp, digest``, distinct and written once."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return stage(items.mapInArrow(_item_windows, "item string, len int, fp long, digest binary").distinct(), "benchmark-windows")


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per document: its id, ``n_words``, ``n_hit``, ``spans`` (first word and number of words of each stretch of hit words) and ``items`` (ids as text, sorted)."""

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_windows else df  # a checked size

    windows = benchmark_windows(benchmark, item_col, item_text)
    lengths = [r["len"] for r in windows.select("len").distinct().collect()]  # WINDOW values at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    places = stage(texts.mapInArrow(_places(bitmap_of(windows), lengths), f"id {kind}, {PLACES}"), "places")
    # a window's items as a key, and one spelled-out list of rows for each such key
    mark = F.xxhash64("item").cast("decimal(38,0)")
    keyed = windows.groupBy("fp", "digest", "len").agg(F.concat_ws(" ", F.count("item"), F.sum(mark), F.bit_xor(F.xxhash64("item", F.lit(1)))).alias("set"))
    keyed = stage(keyed, "window-sets")
    first = keyed.groupBy("set").agg(F.min(F.struct("digest", "len")).alias("one")).select("set", "one.*")
    members = stage(first.join(windows.select("digest", "len", "item"), ["digest", "len"]).where("item is not null").select("set", "item").distinct(), "set-items")

    met = places.where("words is not null")
    classes = met.groupBy("words").agg(F.first(F.arrays_zip("start", "len", "fp", "digest")).alias("at"))
    each = classes.select("words", F.explode("at").alias("at")).select("words", "at.*")
    hits = stage(each.join(sent(keyed), ["fp", "digest", "len"]).select("words", "start", "len", "set"), "hits")
    # a text's windows are at most as many as its words, for each length
    covered = hits.select("words", "start", "len").distinct().groupBy("words").agg(F.array_sort(F.collect_list(F.struct("start", "len"))).alias("at"))
    spans = covered.mapInArrow(_spans, "words binary, n_hit long, spans array<struct<start:long,length:long>>")
    listed = hits.select("words", "set").distinct().join(sent(members), "set").select("words", "item").distinct()
    listed = listed.groupBy("words").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = stage(spans.join(listed, "words", "left"), "found")

    joined = met.select("id", "n_words", "words").join(sent(found), "words", "left").select("id", "n_words", "n_hit", "spans", "items")
    clean = places.where("words is null").select("id", "n_words", *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("n_hit", "spans", "items")))
    none = {"n_hit": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<start:long,length:long>>"), "items": F.array().cast("array<string>")}
    return joined.unionByName(clean).select(F.col("id").alias(id_col), "n_words", *(F.coalesce(c, v).alias(c) for c, v in none.items()))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of sorted windows, and how many words they cover."""
    for batch in batches:
        hit, spans = [], []
        for at in batch.column(1).to_pylist():
            own: list[dict] = []
            for w in at:
                if own and w["start"] <= own[-1]["start"] + own[-1]["length"]:
                    own[-1]["length"] = max(own[-1]["length"], w["start"] + w["len"] - own[-1]["start"])
                else:
                    own.append({"start": w["start"], "length": w["len"]})
            spans.append(own)
            hit.append(sum(s["length"] for s in own))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hit, pa.int64()), pa.array(spans, kind)], names=["words", "n_hit", "spans"])


def digests(found: DataFrame) -> DataFrame:
    """Counts, and a digest of the list of items."""
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Every word window of the documents against those of the benchmark, in DuckDB's SQL.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS r, CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
bw AS (SELECT r, item, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM b),
ten AS (SELECT r, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS ten FROM dw),
bten AS (SELECT r, item, n, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS ten FROM bw),
items AS (SELECT DISTINCT item, len(ten) AS n, array_to_string(ten, ' ') AS g FROM bten WHERE len(ten) = least(n, {WINDOW})),
sizes AS (SELECT DISTINCT n FROM items),
hits AS (SELECT t.r, t.i, t.n, items.item FROM (SELECT r, i, n, array_to_string(ten[1:n], ' ') AS g FROM ten, sizes WHERE len(ten) >= n) t JOIN items ON items.n = t.n AND items.g = t.g),
words AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
lists AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN lists USING (r)
"""
