"""Token counts through a digest cache.

A text's key is the digest of its normalised content together with a version: the digest of the tokenizer's file, its
library with the release, and the rule of normalisation. Counts are kept in a Parquet table by key, in a folder that stays
(``CACHE_FOLDER`` in the shared folder, by default), dealt to ``PARTS`` parts by the digest's first digit and sorted by it in
each file. A run takes the stored counts of its own keys (by a semi join: only they move on, and where they are few the
table is not shuffled), encodes each distinct missing content once, appends the new counts, and joins the counts back to
the documents. :func:`compact` writes a version's many small files again as few. Contents that more than ``HOT_SHARE`` of the rows have are few by that rule, so their counts go
to every task; only the others are shuffled.

Normalisation never changes a count: runs of ASCII white space become one space where the tokenizer drops white
space (see :func:`tidemill.llm.tokens.drops_white_space`); for other tokenizers the content stays as it is.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows each give a row; an empty table
gives no rows; texts of any length are counted whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import metadata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.tokens import counter, drops_white_space, file_digest, public_path
from tidemill.session import shared_dir, stage

LIMIT = 2048
CACHE = "content binary, n_tokens long, version string, part string"
#: Release of the rule of normalisation in :func:`content_digest`; raise it with every change there.
NORMAL_FORM = 1
#: Parts of the table of counts.
PARTS = 16
#: Files that one append gives each part, at most.
FILES = 4
#: Missing keys that are sent to every task instead of shuffling the texts (32 bytes a key).
BROADCAST_KEYS = 200_000
#: Share of the rows from which a content is hot: at most 1 / HOT_SHARE contents are.
HOT_SHARE = 0.001
#: Folder of stored counts in the shared folder.
CACHE_FOLDER = "tidemill/token-counts-by-part"
#: Texts of about this many characters go to the encoder together.
ENCODE_CHARS = 4_000_000


def content_digest(text: Column, tokenizer: str) -> Column:
    """Digest of the normalised content."""
    whole = F.coalesce(text, F.lit(""))
    if tokenizer.endswith(".json") and drops_white_space(tokenizer):
        whole = F.trim(F.regexp_replace(whole, r"[ \t\n\x0B\f\r]+", " "))
    return F.unhex(F.sha2(whole, 256))


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            texts, counts, part, held = batch.column(1), [], [], 0
            for text in texts:
                part.append(text.as_py())
                held += len(part[-1])
                if held >= ENCODE_CHARS:
                    counts += count(part)
                    part, held = [], 0
            counts += count(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    return run


def counted_by(tokenizer: str) -> str:
    """Version of counts: what a count depends on besides the content."""
    name = "tokenizers" if tokenizer.endswith(".json") else "sentencepiece"
    return f"{file_digest(tokenizer)}-{name}-{metadata.version(name)}-{NORMAL_FORM}"


def _part() -> Column:
    return F.substring(F.hex("content"), 1, 1)


def _append(counts: DataFrame, version: str, cache: str) -> None:
    """New counts, a file for each part at most in a task."""
    rows = counts.select("content", "n_tokens", F.lit(version).alias("version"), _part().alias("part"))
    rows.repartition(PARTS * FILES, "part", F.pmod(F.xxhash64("content"), F.lit(FILES))).sortWithinPartitions("part", "content").write.mode("append").partitionBy("version", "part").parquet(cache)


def compact(spark: SparkSession, cache: str, version: str, to: str) -> None:
    """A version's counts as few files in another folder, each content once; readers are pointed at that folder afterwards."""
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    _append(counts, version, to)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, cache: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes, n_tokens, over_limit. ``cache``: folder of stored counts (default: the one in the shared folder)."""
    spark = docs.sparkSession
    tokenizer = tokenizer or public_path("word_bpe_49k.json")
    version = counted_by(tokenizer)
    cache = cache or f"{shared_dir(spark)}/{CACHE_FOLDER}"
    spark.createDataFrame([], CACHE).write.mode("ignore").partitionBy("version", "part").parquet(cache)

    def stored() -> DataFrame:
        return spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).select("content", "n_tokens")

    text = F.col(text_col).cast("string")
    keyed = stage(docs.select(F.col(id_col), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"), content_digest(text, tokenizer).alias("content")), "contents")
    times = stage(keyed.groupBy("content").agg(F.count(F.lit(1)).alias("rows")), "distinct")
    own = F.broadcast(times.select("content")) if times.count() <= BROADCAST_KEYS else times.select("content")  # a checked size
    before = stage(stored().join(own, "content", "left_semi").groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "stored-counts")
    missing = stage(times.select("content").join(before.select("content"), "content", "left_anti"), "missing")
    n_missing = missing.count()
    if n_missing:
        texts = docs.select(content_digest(text, tokenizer).alias("content"), F.coalesce(text, F.lit("")).alias("whole"))
        if n_missing <= BROADCAST_KEYS:  # a checked size: texts that are known already are never shuffled
            texts = texts.join(F.broadcast(missing), "content", "left_semi").dropDuplicates(["content"])
        else:
            texts = texts.dropDuplicates(["content"]).join(missing, "content", "left_semi")
        encoded = stage(texts.mapInArrow(_encode(tokenizer), "content binary, n_tokens long"), "new-counts")
        _append(encoded, version, cache)
        before = before.unionByName(encoded)
    known = times.join(before, "content")
    n_rows = times.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    is_hot = F.col("rows") > HOT_SHARE * n_rows
    hot = stage(known.where(is_hot).select("content", "n_tokens"), "hot-counts")
    out = keyed.join(F.broadcast(hot), "content").unionByName(keyed.join(F.broadcast(hot.select("content")), "content", "left_anti").join(known.where(~is_hot).select("content", "n_tokens"), "content"))
    return out.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
