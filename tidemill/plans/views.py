"""The library's entities as views over the given tables.

The given tables hold no posts, job ads or subscriptions, so each entity is a fixed mapping of a given table. A view's
text runs in Spark SQL and in DuckDB alike, so a query and its counterpart start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import spread, table

VIEWS = {
    # orders as job ads, which are also the publishing queue
    "jobs": """SELECT o_orderkey AS id, o_custkey AS user_id,
  CASE WHEN o_orderkey % 10 = 0 THEN 'project' ELSE 'job' END AS kind,
  CASE WHEN o_orderkey % 4 = 0 THEN 'user' ELSE 'aggregator' END AS origin,
  lower(substring(o_orderpriority, 3)) AS category,
  CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE 'role' || CAST(o_custkey % 7 AS VARCHAR(9)) END AS profession,
  lower(r_name) AS region, o_orderkey % 9 = 0 AS is_remote, n_name AS source,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS salary_min,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) + 50000 END AS salary_max,
  CASE o_orderkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'RUB' ELSE 'UZS' END AS currency,
  CASE o_custkey % 4 WHEN 0 THEN 'month' WHEN 1 THEN NULL WHEN 2 THEN 'day' ELSE 'year' END AS salary_period,
  CASE WHEN o_orderstatus = 'O' THEN 'published' WHEN o_orderkey % 3 = 0 THEN 'queued' WHEN o_orderkey % 3 = 1 THEN 'retry' ELSE 'failed' END AS status,
  o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 1 DAY END AS published_at,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate + INTERVAL 31 DAY END AS expires_at,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate + INTERVAL 2 DAY END AS next_retry_at,
  CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(1 + o_custkey % 3 AS INT) END AS priority_tier,
  CAST(o_orderkey % 9 AS INT) AS attempts,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END AS raw_post_id,
  lower(substring(o_orderpriority, 3)) || ' ' || lower(r_name) || ' ' || lower(n_name) || ' role' || CAST(o_custkey % 7 AS VARCHAR(9)) AS search_text
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    # documents as collected posts
    "posts": """SELECT doc_id AS id, source, CAST(doc_id AS VARCHAR(20)) AS external_id, text, lang,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '37' MINUTE * doc_id AS fetched_at,
  CASE WHEN doc_id % 10 = 3 THEN NULL ELSE TIMESTAMP '2023-12-31 22:00:00' + INTERVAL '37' MINUTE * doc_id END AS posted_at,
  CASE doc_id % 9 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'not_job' WHEN 2 THEN 'resume' WHEN 3 THEN 'suspicious' WHEN 4 THEN 'no_contact' WHEN 5 THEN 'error' ELSE 'done' END AS status,
  doc_id % 17 = 0 AS is_backfill
FROM {documents}""",
    # customers as users
    "users": """SELECT c_custkey AS id, c_name AS name, c_acctbal < 0 AS is_banned, c_mktsegment AS segment, c_nationkey AS nation,
  TIMESTAMP '1995-01-01 00:00:00' + INTERVAL '13' HOUR * c_custkey AS created_at FROM {customer}""",
    # and their standing subscriptions: two for every third user
    "subscriptions": """SELECT c_custkey * 2 + k AS id, c_custkey AS user_id,
  CASE c_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'urgent' WHEN 2 THEN 'high' ELSE NULL END AS category,
  CAST(NULL AS VARCHAR(20)) AS profession,
  CASE WHEN k = 0 THEN lower(r_name) WHEN c_custkey % 2 = 0 THEN 'remote' ELSE NULL END AS region,
  CASE WHEN c_custkey % 5 = 0 THEN 300000 ELSE NULL END AS min_salary,
  CASE WHEN c_custkey % 6 = 0 THEN 'Nation_1 role' ELSE NULL END AS keyword,
  c_acctbal < 9000 AS is_active, TIMESTAMP '1995-01-01 00:00:00' + INTERVAL '1' DAY * c_custkey AS created_at
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) AS two WHERE c_custkey % 3 = 0""",
}

#: Tables that have the rows of an entity.
LARGE = ("orders", "documents")
#: The moment that queries take as now.
NOW = "1998-06-01 12:00:00"
NAMES = re.compile(r"\{(\w+)\}")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def view(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """An entity as a DataFrame. ``wide``: its large table is spread over all cores before it is joined, for work that is heavy beside reading."""
    text = VIEWS[name]
    return spark.sql(text, **{t: spread(table(spark, sf_dir, t)) if wide and t in LARGE else table(spark, sf_dir, t) for t in set(NAMES.findall(text))})


def ctes(*names: str) -> str:
    """``WITH`` clause of entities in DuckDB's SQL."""
    return "WITH " + ", ".join(f"{n} AS ({NAMES.sub(lambda m: m[1], VIEWS[n])})" for n in names) + " "
