"""The stored text index: equal to a rebuild after inserts, changes, deletes and merges; reads the folders of a prefix only."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.operators import search, text_index

CHANGE = "id long, old_text string, new_text string, version long"
WORDS = ["driver", "drive", "dry", "cook", "coach", "clerk", "night", "ночь", "ночной", "a1", "x"]


def rebuilt(spark, texts, keyword):
    jobs = spark.createDataFrame([(i, t) for i, t in texts.items() if t is not None] or [(0, "")], "id long, search_text string")
    return sorted(r["id"] for r in search.with_words(search.token_index(jobs), keyword).collect())


def found(spark, path, keyword):
    return sorted(r["id"] for r in text_index.find(spark, path, keyword).collect())


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/index"


def test_equals_a_rebuild(spark, path):
    rng, texts, version = random.Random(31), {}, 0
    for step in range(5):
        changes = []
        for _ in range(30):
            i, version = rng.randint(1, 40), version + 1
            new = None if rng.random() < 0.2 else " ".join(rng.sample(WORDS, rng.randint(0, 4)))
            changes.append((i, texts.get(i), new, version))
            texts[i] = new
        assert text_index.append(spark.createDataFrame(changes, CHANGE), path, f"s{step}")
        assert not text_index.append(spark.createDataFrame(changes, CHANGE), path, f"s{step}")
    before = text_index.segments(spark, path)
    for keyword in ("dri", "dr co", "ночь", "ноч cl", "zz", "clerk night"):
        assert found(spark, path, keyword) == rebuilt(spark, texts, keyword), keyword
    assert text_index.merge(spark, path) == 1 and len(text_index.segments(spark, path)) < len(before)
    assert len(text_index.unused(spark, path)) == 5
    for keyword in ("dri", "dr co", "ночь", "x"):
        assert found(spark, path, keyword) == rebuilt(spark, texts, keyword), keyword


def test_reads_the_prefixes_of_the_words_only(spark, path):
    text_index.append(spark.createDataFrame([(1, None, "driver cook", 1), (None, None, "cook", 1), (2, None, None, 1)], CHANGE), path)
    found_ = text_index.index_for(spark, path, "driv")
    plan = found_._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(prefix#\d+ = dr\)", plan), plan
    every = text_index._postings(spark, path, [n for n, _ in text_index.segments(spark, path)])
    assert {r["f"].split("prefix=")[1][:2] for r in every.where("prefix = 'dr'").select(F.input_file_name().alias("f")).distinct().collect()} == {"dr"}
    assert found(spark, path, "dri") == [1] and found(spark, path, "coo") == [1] and found(spark, path, "") == []


def test_an_empty_index_finds_nothing(spark, path):
    assert found(spark, path, "driver") == [] and text_index.merge(spark, path) == 0


def test_a_stream_is_followed_once(spark, tmp_path, path):
    source, mark = f"{tmp_path}/changes", f"file://{tmp_path}/mark"
    rows = [(k, None, f"driver number{k}", 1) for k in range(6)]
    for part in (rows[:3], rows[3:], [(0, "driver number0", None, 2), (1, "driver number1", "cook", 2)]):
        spark.createDataFrame(part, CHANGE).coalesce(1).write.mode("append").json(source)
        text_index.follow(spark.readStream.schema(CHANGE).json(source), path, mark).awaitTermination()
    text_index.follow(spark.readStream.schema(CHANGE).json(source), path, mark).awaitTermination()
    assert found(spark, path, "driver") == [2, 3, 4, 5] and found(spark, path, "cook") == [1]
    assert len(text_index.segments(spark, path)) == 3


def test_a_hot_prefix_is_cut_by_its_postings(spark, tmp_path, monkeypatch):
    """A run of a segment holds a bounded number of postings, whatever share of them one token has; so do the tasks that merge."""
    monkeypatch.setattr(text_index, "RUN_ROWS", 500)
    path = f"file://{tmp_path}/index"
    for step in range(text_index.FAN):
        made = spark.range(step * 2000, step * 2000 + 2000).select("id", F.lit(None).cast("string").alias("old_text"), F.expr("'role' || if(id % 100 = 0, ' driver', '')").alias("new_text"), F.lit(step + 1).alias("version"))
        assert text_index.append(made, path, f"s{step}")
    gone = spark.range(0, 8000, 400).select("id", F.lit("role driver").alias("old_text"), F.lit("role").alias("new_text"), F.lit(9).alias("version"))
    assert text_index.merge(spark, path) == 1 and text_index.append(gone, path, "last")

    every = text_index._postings(spark, path, [n for n, _ in text_index.segments(spark, path)])
    runs = {r["f"]: r["n"] for r in every.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(runs.values()) < 2 * text_index.RUN_ROWS and sum(runs.values()) == 8000 + 80 + 20
    assert found(spark, path, "role") == list(range(8000))
    assert found(spark, path, "driver role") == [i for i in range(0, 8000, 100) if i % 400]
