"""Queries over stored structures that Spark derives from the given tables: a text index with changes, landed posts, admin alerts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import alerts, text_index
from tidemill.plans.catalog import query
from tidemill.plans.views import ctes, view
from tidemill.session import shared_dir, table
from tidemill.sources import landed
from tidemill.streaming import admin_alerts as told


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"


# every job is indexed; then those that failed go, and those that wait for a retry are worded anew
_NEW = "CASE WHEN status = 'failed' THEN NULL WHEN status = 'retry' THEN 'renewed ' || coalesce(profession, 'asia') ELSE search_text END"


@query("stored_search", ctes("jobs").rstrip() + f""", t AS (SELECT id, {_NEW} AS words FROM jobs) SELECT id FROM t WHERE regexp_matches(words, '(^|[^\\p{{L}}\\p{{N}}_])as') AND regexp_matches(words, '(^|[^\\p{{L}}\\p{{N}}_])ur|(^|[^\\p{{L}}\\p{{N}}_])ren') AND regexp_matches(words, '(^|[^\\p{{L}}\\p{{N}}_])(ur|asi)')""")
def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index of all jobs after two rounds of changes and a merge, searched by prefixes of words."""
    jobs, path = view(spark, sf_dir, "jobs"), _folder(spark, "text-index")
    none = F.lit(None).cast("string")
    text_index.append(jobs.select("id", none.alias("old_text"), F.col("search_text").alias("new_text"), F.lit(1).alias("version")), path, "all")
    changed = jobs.where("status in ('failed', 'retry')").select("id", F.col("search_text").alias("old_text"), F.expr(_NEW).alias("new_text"), F.lit(2).alias("version"))
    text_index.append(changed.where("new_text is null"), path, "gone")
    text_index.append(changed.where("new_text is not null"), path, "renewed")
    text_index.append(changed.where("false"), path, "nothing")
    text_index.merge(spark, path)
    urgent, renewed = text_index.find(spark, path, "as ur"), text_index.find(spark, path, "ren asi")
    return urgent.unionByName(renewed).distinct()


@query("landed_posts", ctes("posts") + "SELECT id, source, md5(text) AS digest, posted_at FROM posts WHERE id > 40 AND source <> 'src1'")
def landed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All posts landed in lots and read by the registered source beyond a cursor."""
    posts, path = view(spark, sf_dir, "posts"), _folder(spark, "landed")
    landed.land(posts.select(F.col("id").alias("key"), "source", "external_id", "text", F.col("posted_at").cast("timestamp"), F.col("fetched_at").cast("timestamp")), path)
    read = landed.register(spark).read.format("landed").option("path", path).load()
    return read.where("key > 40 and source <> 'src1'").select(F.col("key").alias("id"), "source", F.md5("text").alias("digest"), "posted_at")


def admin_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that hold a word which an admin watches for."""
    words = [(1, 1, "the"), (1, 2, "und"), (2, 3, "las"), (2, 4, "werden"), (3, 5, "des")]
    watched = spark.createDataFrame(words, "owner long, subscription_id long, word string")
    posts = view(spark, sf_dir, "posts")
    found = alerts.watch(posts, watched)
    return found.join(posts.select("id", "fetched_at"), "id").select("owner", F.col("id").alias("post_id"), "subscription_id", F.lit("2024-01-01 12:00:00").cast("timestamp").alias("subscribed_at"), F.col("fetched_at").cast("timestamp"))


@query("admin_alerts")
def admin_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts and lists of watched words over all posts; a test compares them with a loop."""
    # posts come every 37 minutes, so an hour's cap of one and lists of three hours
    return told.told(admin_hits(spark, sf_dir), 1, 180)
