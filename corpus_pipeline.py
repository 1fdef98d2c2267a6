"""The corpus pipeline: stages over ``documents``, each written and read again.

1. Language ID: documents without a letter, or whose best language scores less than ``LEAST_LIFT`` times what chance
   would give among the languages learned, are rejected; a missing language label is filled in.
2. Near-duplicate removal: of each component the document with the smallest id stays (one row of it).
3. Mixing: documents are repeated, or left out, so that each source reaches its target weight.
4. Packing: what is left becomes sequences of 2048 tokens.

Defined results, in all stages: an empty table gives no rows; columns beyond those of ``documents`` are ignored,
whatever their names; texts of any length are read whole.

- Stage 1 rejects null and letterless texts, and every text where nothing is labelled; repeated rows are each judged
  alike; a null id, source or n_chars stays as it is.
- Stage 2 keeps texts without words (they are linked with nothing) and rows without an id; rows that share an id are
  one document, of which the first in the order of its columns stays.
- Stage 3 draws rows with the same id and source alike; a null source is a source of its own; null texts have size 0.
- Stage 4 packs a null text as an empty one (its end mark only); repeated rows are packed each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import langid, mixing, near_dups, packing
from tidemill.session import prepare, stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least score as a multiple of one over the number of languages. Texts in two languages and very short ones score little more.
LEAST_LIFT = 1.2
#: Ids of removed documents that are sent to every task; with more of them the texts are shuffled.
BROADCAST_IDS = 2_000_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: keep documents whose language is recognised."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    net = langid.train(docs)
    found = langid.identify(docs, net)
    # with few languages chance alone is high; a single language always scores 1
    least = min(LEAST_LIFT / len(net.languages), 1.0) if net else 1.0
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least))
    return kept.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: one document of each near-duplicate component stays."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    removed = stage(near_dups.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "removed")
    if removed.count() <= BROADCAST_IDS:  # a checked size
        removed = F.broadcast(removed)
    left = docs.join(removed, "doc_id", "left_anti")
    repeated = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    if not repeated.isEmpty():  # rows that share an id are one document: the first in the order of its columns, in every run
        first = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
        left = left.join(repeated, "doc_id", "left_anti").unionByName(first.select("doc_id", "row.*"))
    return left.select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: repeat documents to the target weights of their sources, in a global random order."""
    prepare(spark)
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: pack what is left into sequences of 2048 tokens."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [("language ID", known_language), ("near dedup", without_near_duplicates), ("mixing", mixed), ("packing", packed)]
#: Trained models and MinHash candidates have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
