"""A stored text index: immutable segments of postings by prefix with delete marks, merged like a log-structured store.

Layout of a folder: ``postings/segment=<name>/prefix=<two letters>`` holds ``token, id, version, gone`` sorted by token, and
``log`` one row for each change of the list of segments. A change of a text (``id, old_text, new_text, version``) becomes
postings of its new tokens and delete marks of those it lost, all under the tokens' own prefixes; so a search reads the
folders of its words' prefixes only, and a posting counts where its token and id have no later mark.

Segments are never changed. :func:`merge` writes those of a level as one of the next and logs that; marks go once nothing older
is left below. :func:`follow` appends a stream's changes; a batch that is run again has its segment in the log already and is
skipped. Replaced folders stay on disk until :func:`unused` names them to whoever cleans up.

Defined results: a null text has no tokens; a change without an id is ignored; of changes to one id in one append the
latest version counts; an empty index finds nothing; tokens keep any letters, prefixes are their first two characters.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.operators.search import MOST_WORDS, with_words, words
from tidemill.session import stage

#: Letters of a prefix, segments of a level that are merged, postings of a run of a segment.
PREFIX, FAN, RUN_ROWS = 2, 4, 1 << 19
POSTINGS = "token string, id long, version long, gone boolean, segment string, prefix string"
LOG = "segment string, level int, replaces array<string>, at long"


def _log(spark: SparkSession, path: str) -> DataFrame:
    spark.createDataFrame([], LOG).write.mode("ignore").parquet(f"{path}/log")
    return spark.read.schema(LOG).parquet(f"{path}/log")


def segments(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, level) of the segments that make up the index, oldest first. There are some ``FAN`` for each level."""
    log = _log(spark, path)
    gone = log.select(F.explode("replaces").alias("segment"))
    return [(r["segment"], r["level"]) for r in log.join(gone, "segment", "left_anti").orderBy("at", "segment").collect()]


def unused(spark: SparkSession, path: str) -> list[str]:
    """Folders of segments that merged ones have replaced."""
    return [f"{path}/postings/segment={r['segment']}" for r in _log(spark, path).select(F.explode("replaces").alias("segment")).distinct().collect()]


def _write(postings: DataFrame, path: str, name: str) -> None:
    """A segment in sorted runs of some ``RUN_ROWS`` postings, so a hot prefix lies in as many runs as it needs. Written once before, as runs are cut by a sample."""
    rows = stage(postings.select("token", "id", "version", "gone", "prefix"), "postings")
    order = ("prefix", "token", "id")
    dealt = rows.repartitionByRange(_runs(rows), *order).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").partitionBy("prefix").parquet(f"{path}/postings/segment={name}")


def _runs(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // RUN_ROWS))


def _note(spark: SparkSession, path: str, name: str, level: int, replaces: list[str]) -> None:
    at = max((r["at"] for r in _log(spark, path).agg(F.max("at").alias("at")).collect() if r["at"] is not None), default=0) + 1
    spark.createDataFrame([(name, level, replaces, at)], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def _tokens(text: Column) -> Column:
    return F.array_distinct(words(F.coalesce(text, F.lit("")), 1))


def append(changes: DataFrame, path: str, name: str | None = None) -> bool:
    """Changes ``id, old_text, new_text, version`` as a new segment; False where a segment of that name is in the log already."""
    spark, name = changes.sparkSession, name or uuid.uuid4().hex
    if not _log(spark, path).where(F.col("segment") == name).isEmpty():
        return False
    last = Window.partitionBy("id").orderBy(F.desc("version"))
    first = Window.partitionBy("id").orderBy("version")
    known = changes.where("id is not null")
    both = known.withColumn("place", F.row_number().over(last)).withColumn("before", F.first("old_text").over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("place = 1")
    old, new = _tokens(F.col("before")), _tokens(F.col("new_text"))
    marks = F.concat(F.transform(F.array_except(new, old), lambda t: F.struct(t.alias("token"), F.lit(False).alias("gone"))), F.transform(F.array_except(old, new), lambda t: F.struct(t.alias("token"), F.lit(True).alias("gone"))))
    postings = both.select("id", F.col("version").cast("long").alias("version"), F.explode(marks).alias("m")).select("id", "version", "m.*").withColumn("prefix", F.substring("token", 1, PREFIX))
    _write(postings, path, name)
    _note(spark, path, name, 0, [])
    return True


def _postings(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], POSTINGS)
    return spark.read.schema(POSTINGS).option("basePath", f"{path}/postings").parquet(*(f"{path}/postings/segment={n}" for n in names))


def _latest(postings: DataFrame, n: int | None = None) -> DataFrame:
    """The last posting of each token and id. Almost none meets another, so rows are dealt out (to ``n`` tasks) before they are grouped: a table of
    the groups of a whole file, which may hold tens of millions, would shrink nothing."""
    key = ("prefix", "token", "id")
    dealt = postings.repartition(*key) if n is None else postings.repartition(n, *key)
    return dealt.groupBy(*key).agg(F.max_by("gone", "version").alias("gone"), F.max("version").alias("version"))


def merge(spark: SparkSession, path: str) -> int:
    """Merge levels that have ``FAN`` segments, lowest first; how many merges were made."""
    made = 0
    while True:
        live = segments(spark, path)
        full = next((lv for lv in sorted({lv for _, lv in live}) if sum(x == lv for _, x in live) >= FAN), None)
        if full is None:
            return made
        # levels grow with age, so a level's segments are neighbours in time
        names = [n for n, lv in live if lv == full]
        oldest = not any(lv > full for _, lv in live)
        parts = _postings(spark, path, names)
        merged = _latest(parts, _runs(parts))
        name = uuid.uuid4().hex
        _write(merged.where("not gone") if oldest else merged, path, name)
        _note(spark, path, name, full + 1, names)
        made += 1


def index_for(spark: SparkSession, path: str, keyword: str) -> DataFrame:
    """Live postings ``prefix, token, id`` under the prefixes of a keyword's words: only their folders are read."""
    asked = [r["w"] for r in spark.range(1).select(F.explode(F.slice(words(F.lit(keyword)), 1, MOST_WORDS)).alias("w")).collect()]
    near = _postings(spark, path, [n for n, _ in segments(spark, path)]).where(F.col("prefix").isin(sorted({w[:PREFIX] for w in asked})))
    begins = F.lit(False)
    for w in asked:
        begins = begins | F.col("token").startswith(w)
    return _latest(near.where(begins)).where("not gone").select("prefix", "token", "id")


def find(spark: SparkSession, path: str, keyword: str) -> DataFrame:
    """Ids whose tokens start with each of the first words of ``keyword``."""
    return with_words(index_for(spark, path, keyword), keyword, PREFIX)


def follow(changes: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Append a stream of changes to the index, a segment for each batch, and merge; a repeated batch changes nothing."""
    run = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex[:12]

    def put(batch: DataFrame, number: int) -> None:
        append(batch, path, f"{run}-{number:012d}")
        merge(batch.sparkSession, path)

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**(trigger or {"availableNow": True})).start()
