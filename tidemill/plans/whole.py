"""Queries that hold one part of a table against the other; the parts are told apart by a column's value and cover the table together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import queue, reports, search, submissions
from tidemill.plans.catalog import query
from tidemill.plans.views import NOW, ctes, now, view
from tidemill.session import spread, table
from tidemill.streaming import posts as steps

RATE = 12500.0
T = f"TIMESTAMP '{NOW}'"


@query("rate_as_of_all", """WITH rates AS (SELECT date_trunc('day', l_shipdate) AS day, max(l_extendedprice) AS rate FROM lineitem GROUP BY 1),
sane AS (SELECT * FROM rates WHERE rate > 1000 AND rate < 100000) SELECT o_orderkey AS id, coalesce(rate, 12500.0) AS usd_rate FROM orders ASOF LEFT JOIN sane ON o_orderdate >= day""")
def rate_as_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest rate of all line items at each job's date, else the fall-back."""
    rates = table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("day", "l_shipdate").alias("day")).agg(F.max("l_extendedprice").alias("rate"))
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    return search.as_of_rate(jobs, rates, RATE, at="o_orderdate").select("id", "usd_rate")


@query("repeated_drafts_all", ctes("jobs") + f"SELECT d.id, min(j.id) AS job_id FROM jobs d JOIN jobs j ON d.user_id = j.user_id AND d.category || d.region = j.category || j.region WHERE d.status <> 'published' AND j.status = 'published' AND j.created_at >= {T} - INTERVAL 900 DAY GROUP BY d.id")
def repeated_drafts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpublished jobs that repeat a recent published one."""
    jobs, out = view(spark, sf_dir, "jobs").withColumn("digest", F.concat("category", "region")), F.col("status") == "published"
    return submissions.repeated(jobs.where(~out).select("id", "user_id", "digest"), jobs.where(out), now(), 900)


@query("insert_ignore_all", """SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE ts < TIMESTAMP '2024-01-03 00:00:00')""")
def insert_ignore_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of later events that no earlier event has stored, once each."""
    events, stored = table(spark, sf_dir, "events").select("ts", "user_id", "event_type"), F.col("ts") < F.lit("2024-01-03").cast("timestamp")
    return search.insert_ignore(events.where(~stored), events.where(stored), ["user_id", "event_type"]).select("user_id", "event_type")


@query("coverage_grid_all", """WITH assets AS (SELECT p_brand AS folder, p_name || CAST(p_partkey AS VARCHAR) AS path, p_size % 3 = 0 AS is_placeholder FROM part), grid AS (SELECT DISTINCT p_brand AS folder, slot FROM part, (SELECT unnest(range(1, 4)) AS slot)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY is_placeholder, path) AS slot FROM assets) SELECT folder, CAST(slot AS INT) AS slot, path, CASE WHEN path IS NULL THEN 'gap' WHEN is_placeholder THEN 'placeholder' ELSE 'real' END AS state FROM grid LEFT JOIN ranked USING (folder, slot)""")
def coverage_grid_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of every folder against all parts as assets."""
    part = table(spark, sf_dir, "part")
    assets = part.select(F.col("p_brand").alias("folder"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") % 3 == 0).alias("is_placeholder"))
    return reports.coverage_grid(part.select(F.col("p_brand").alias("folder")), assets, 3)


@query("rotating_assets_all", ctes("jobs").rstrip() + """, a AS (SELECT CASE p_size % 4 WHEN 0 THEN 'role' || CAST(p_partkey % 4 AS VARCHAR) WHEN 1 THEN 'low' WHEN 2 THEN 'high' ELSE 'default' END AS folder, p_name || CAST(p_partkey AS VARCHAR) AS path, p_size % 3 = 0 AS ph FROM part),
best AS (SELECT folder, path FROM a WHERE NOT ph OR folder NOT IN (SELECT folder FROM a WHERE NOT ph)), b AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY path) - 1 AS nth, count(*) OVER (PARTITION BY folder) AS n FROM best),
j AS (SELECT id, created_at, CASE WHEN profession IN (SELECT folder FROM b) THEN profession WHEN category IN (SELECT folder FROM b) THEN category ELSE 'default' END AS folder FROM jobs), t AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY created_at, id) - 1 AS turn FROM j)
SELECT id, t.folder, path FROM t JOIN b ON t.folder = b.folder AND t.turn % b.n = b.nth""")
def rotating_assets_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: an asset for each job, in turn, from all parts."""
    size = F.col("p_size")
    folder = F.when(size % 4 == 0, F.concat(F.lit("role"), (F.col("p_partkey") % 4).cast("string"))).when(size % 4 == 1, "low").when(size % 4 == 2, "high").otherwise("default")
    assets = table(spark, sf_dir, "part").select(folder.alias("folder"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"), (size % 3 == 0).alias("is_placeholder"))
    return queue.rotate(view(spark, sf_dir, "jobs").select("id", "created_at", "profession", "category"), assets)


@query("source_overview_all", ctes("posts") + "SELECT s.source, coalesce(c.n, 0) AS posts, c.newest FROM (SELECT 'src' || s_suppkey AS source FROM supplier) s LEFT JOIN (SELECT source, count(*) AS n, max(coalesce(posted_at, fetched_at)) AS newest FROM posts GROUP BY source) c USING (source)")
def source_overview_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's source with its posts, empty ones included."""
    sources = table(spark, sf_dir, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("source"))
    return submissions.source_overview(sources, view(spark, sf_dir, "posts"))


@query("open_page_all", ctes("jobs") + f"SELECT id, category FROM jobs WHERE kind = 'job' AND status = 'published' AND (expires_at IS NULL OR expires_at > {T})")
def open_page_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All visible jobs."""
    return view(spark, sf_dir, "jobs").where(search.is_open(now())).select("id", "category")


@query("album_rows_all", ctes("posts", "jobs") + "SELECT p.id FROM posts p WHERE (p.id % 7 <> 0 AND (p.id - 1) IN (SELECT id FROM jobs WHERE status = 'published')) OR p.id IN (SELECT raw_post_id FROM jobs WHERE status = 'published')")
def album_rows_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16: all posts behind all published jobs, once each."""
    jobs = view(spark, sf_dir, "jobs").where("status = 'published'").select("id", "raw_post_id")
    posts = view(spark, sf_dir, "posts").select("id", F.when(F.col("id") % 7 != 0, F.col("id") - 1).alias("job_id"))
    return submissions.current_rows(jobs, posts).select("id")


@query("album_texts", """WITH p AS (SELECT event_type AS source, user_id % 20 AS grouped_id, event_id AS id, ts AS fetched_at, props AS text FROM events), g AS (SELECT *, CASE WHEN fetched_at >= lag(fetched_at) OVER w + INTERVAL 3600 SECOND THEN 1 ELSE 0 END AS new FROM p WINDOW w AS (PARTITION BY source, grouped_id ORDER BY fetched_at, id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY source, grouped_id ORDER BY fetched_at, id) AS k FROM g) SELECT source, grouped_id, min(id) AS id, count(*) AS n_parts, max(fetched_at) AS fetched_at, md5(string_agg(text, chr(10) ORDER BY id)) AS digest FROM s GROUP BY source, grouped_id, k""")
def album_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that arrive close together as one post, with the digest of their merged texts."""
    parts = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), (F.col("user_id") % 20).alias("grouped_id"), F.col("event_id").alias("id"), F.col("props").alias("text"), F.col("ts").alias("fetched_at"))
    return steps.albums(parts, 3600).withColumn("digest", F.md5("text")).drop("text")


@query("slugs_all", "SELECT doc_id, regexp_replace(substr(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', '-', 'g'), 1, 60), '^-+|-+$', '', 'g') AS slug FROM documents")
def slugs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL slugs of whole first lines."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", text.slug(F.substring_index("text", "\n", 1)).alias("slug"))


@query("source_changes", "SELECT s_name AS identifier, CASE WHEN s_acctbal < 6000 THEN 'new' ELSE 'old' END AS url, CASE WHEN s_acctbal >= 3000 THEN 'kept' ELSE 'fresh' END AS note FROM supplier")
def source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source dimension after a change of its configuration: stored sources, configured ones, and those that are both."""
    s, worth = table(spark, sf_dir, "supplier"), F.col("s_acctbal")
    old = s.where(worth >= 3000).select(F.col("s_name").alias("identifier"), F.lit("old").alias("url"), F.lit("kept").alias("note"))
    new = s.where(worth < 6000).select(F.col("s_name").alias("identifier"), F.lit("new").alias("url"), F.lit("fresh").alias("note"))
    return steps.synced_sources(old, new, ["url"], ["note"])


@query("asset_changes", "SELECT p_partkey AS path, CASE WHEN p_size > 20 AND p_retailprice > 1200 THEN 'x' ELSE p_brand END AS digest, CASE WHEN p_size <= 35 AND (p_size <= 20 OR p_retailprice <= 1200) THEN p_size END AS cached_id, p_size > 35 AS added FROM part")
def asset_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asset table after a scan of the files: files that are gone, changed, the same and new."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    old = p.where(size <= 35).select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("digest"), F.col("p_size").alias("cached_id"))
    new = p.where(size > 20).select(F.col("p_partkey").alias("path"), F.when(F.col("p_retailprice") > 1200, "x").otherwise(F.col("p_brand")).alias("digest"))
    return steps.synced_assets(old, new)
