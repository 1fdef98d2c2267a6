"""Registered queries of this subpackage, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import chat, decontamination, hard_negatives, html_text, langid, media, mixing, near_dups, packing, periodic_runs, sharding, token_counts, topk
from tidemill.session import spread, stage, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents repeated so that every source reaches its target weight, in a global random order."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds marks of templates, formatted in budgeted windows, written and read back."""
    mark = "</s>[INST] ok [/INST]"
    chats = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", mark), (-7, 1, "assistant", mark)], "conv_id long, turn long, role string, text string")
    return chat.read_back(stage(chat.format_chats(chats.unionByName(extra)), "windows"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, every distinct text encoded once."""
    return token_counts.count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of every vector whose id is divisible by 20, against all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards along a Hilbert curve, whole texts in them; sizes and digests are those of the texts read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text").withColumn("tie", F.xxhash64("text"))
    text = F.coalesce("text", F.lit(""))
    placed = sharding.shards(docs, ties=("doc_id", "tie"))
    size, digest = F.octet_length(text).cast("long") + 1, F.crc32(text.cast("binary"))
    return placed.select("doc_id", size.alias("size"), digest.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a motion-JPEG AVI file in the shared folder, read back from there and cut into shots."""
    files = media.store(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    stored = stage(files, "media", **{"compression": "zstd", "parquet.compression.codec.zstd.level": "6"})
    return media.describe(stored)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    net = langid.train(docs)
    out = F.coalesce(langid.held_out(), F.lit(False)).alias("held_out")
    return langid.identify(spread(docs.select("doc_id", out, "text")), net, keep_text=False)


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dups.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(spread(pages), html_text.train(pages))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 100 and each of its five positives, five rows of other labels in the window; every seventh label is moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")), "vec_id % 100 = 0")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, with periods planted in every tenth."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_planted_periods(docs)))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decontamination.digests(decontamination.find_passages(docs, table(spark, sf_dir, "benchmark")))


_ALL = (op1_packing, op2_mixing, op3_chat, op4_token_counts, op5_topk, op6_sharding, op7_media, op8_langid, op9_near_dups, op10_html, op11_hard_negatives, op12_periodic_runs, op13_decontamination)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.SQL, "op5_topk": topk.SQL, "op11_hard_negatives": hard_negatives.SQL, "op13_decontamination": decontamination.SQL}
