"""The registered source: batch and stream give the same rows, filters reach the reader, a restart repeats nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.sources import landed

T0 = dt.datetime(2024, 1, 1)


def posts(spark, keys):
    return spark.createDataFrame([(k, f"s{k % 3}", str(k), None if k % 5 == 0 else f"text {k}\nsecond — ё", T0 + dt.timedelta(minutes=k), None) for k in keys], landed.SCHEMA)


def keyed(df):
    return sorted((r["key"], r["source"], r["text"], r["posted_at"]) for r in df.collect())


@pytest.fixture
def folder(spark, tmp_path):
    landed.register(spark)
    path = f"file://{tmp_path}/feed"
    landed.land(posts(spark, range(0, 2600)), path)
    return path


def test_reads_what_was_landed(spark, folder):
    read = spark.read.format("landed").option("path", folder).load()
    assert keyed(read) == keyed(posts(spark, range(0, 2600)))
    assert read.rdd.getNumPartitions() == 3
    few = read.where("source = 's1' and key > 1990 and key <= 2010 and text is not null")
    assert keyed(few) == keyed(posts(spark, range(1991, 2011)).where("source = 's1' and text is not null"))
    assert few.rdd.getNumPartitions() == 2  # of three lots
    assert spark.read.format("landed").option("path", folder + "-none").load().count() == 0


def test_stream_equals_batch_and_restarts(spark, folder, tmp_path):
    out, mark = f"{tmp_path}/out", f"{tmp_path}/mark"

    def run():
        stream = spark.readStream.format("landed").option("path", folder).load()
        stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()

    run()
    run()  # nothing new
    landed.land(posts(spark, range(2600, 3700)), folder)
    landed.land(posts(spark, [5]), folder)  # behind the cursor
    run()
    assert keyed(spark.read.parquet(out)) == keyed(posts(spark, range(0, 3700)))


def test_odd_lines(spark, tmp_path):
    landed.register(spark)
    path = f"{tmp_path}/feed"
    spark.createDataFrame([('{"key": 3, "text": "a", "more": 1}',), ("no json",), ('{"text": "no key"}',), ("",), ("[1]",)], "value string").coalesce(1).write.text(f"{path}/lot=0")
    read = spark.read.format("landed").option("path", f"file://{path}").load()
    assert [(r["key"], r["text"], r["source"], r["posted_at"]) for r in read.collect()] == [(3, "a", None, None)]
