"""Queries of search, reports and the publishing queue, each with its counterpart in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import queue, reports, search
from tidemill.plans.catalog import query
from tidemill.plans.views import NOW, ctes, now, view
from tidemill.session import table

RATE = 12500.0
T = f"TIMESTAMP '{NOW}'"
OPEN = f"kind = 'job' AND status = 'published' AND (expires_at IS NULL OR expires_at > {T})"
TIER = "coalesce(priority_tier, 2)"
SHOWN = ["id", "category", "region", "priority_tier", "published_at"]
SHOWN_SQL = ", ".join(SHOWN)


@query("search_filters", ctes("jobs") + f"""SELECT {SHOWN_SQL}, count(*) OVER () AS total FROM jobs
WHERE {OPEN} AND category = 'high' AND region = 'asia' ORDER BY {TIER}, published_at DESC, id DESC LIMIT 20 OFFSET 5""")
def search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters, order, paging and total."""
    return search.search(view(spark, sf_dir, "jobs").select("*"), search.Filters(category="high", region="asia"), now(), RATE, 20, 5).select(*SHOWN, "total")


@query("search_salary", ctes("jobs") + f"""SELECT id, salary_min, salary_max, currency FROM jobs WHERE {OPEN} AND currency IN ('UZS', 'USD')
AND (salary_period IS NULL OR salary_period = 'month') AND (salary_max * CASE WHEN currency = 'USD' THEN {RATE} ELSE 1 END >= 300000 OR salary_min * CASE WHEN currency = 'USD' THEN {RATE} ELSE 1 END >= 300000)""")
def search_salary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay in so'm or dollars a month, either bound."""
    found = search.matching(view(spark, sf_dir, "jobs"), search.Filters(min_salary=300000), now(), RATE)
    return found.select("id", "salary_min", "salary_max", "currency")


@query("search_remote", ctes("jobs") + f"SELECT id, region FROM jobs WHERE {OPEN} AND is_remote AND profession = 'role3'")
def search_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The remote filter and a profession."""
    return search.matching(view(spark, sf_dir, "jobs"), search.Filters(region=search.REMOTE, profession="role3"), now(), RATE).select("id", "region")


@query("search_keyword", ctes("jobs") + f"""SELECT id, search_text FROM jobs WHERE {OPEN}
AND len(list_filter(regexp_extract_all(search_text, '[a-z0-9_]+'), lambda t: starts_with(t, 'nation_1'))) > 0 AND len(list_filter(regexp_extract_all(search_text, '[a-z0-9_]+'), lambda t: starts_with(t, 'urg'))) > 0""")
def search_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word prefixes over an inverted index."""
    return search.matching(view(spark, sf_dir, "jobs"), search.Filters(keyword="Nation_1 URG"), now(), RATE).select("id", "search_text")


@query("token_index", ctes("posts") + """SELECT token, count(DISTINCT id) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM posts) GROUP BY token""")
def token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index of all posts, as document counts of its tokens."""
    return search.token_index(view(spark, sf_dir, "posts"), text_col="text").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("newest_open", ctes("jobs") + f"SELECT id, published_at FROM jobs WHERE {OPEN} ORDER BY published_at DESC, id DESC LIMIT 50")
def newest_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest open jobs."""
    jobs = view(spark, sf_dir, "jobs").where(search.is_open(now()))
    return search.page(jobs.select("id", "published_at"), [F.desc("published_at"), F.desc("id")], 50)


@query("search_log_last", """SELECT user_id, arg_max(props, (ts, event_id)) AS filters, max(ts) AS created_at FROM events WHERE event_type = 'view' GROUP BY user_id""")
def search_log_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's latest logged search."""
    log = table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", F.col("props").alias("filters"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))
    return search.last_search(log)


@query("saved_jobs", ctes("jobs") + """SELECT j.id, category, status, f.ts AS saved_at, count(*) OVER () AS total FROM (SELECT user_id, value_id AS job_id, ts FROM (SELECT user_id, event_id AS value_id, ts FROM events WHERE event_type = 'click') WHERE user_id = 7) f JOIN jobs j ON j.id = f.job_id ORDER BY saved_at DESC, id DESC LIMIT 15""")
def saved_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's saved jobs."""
    saved = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", F.col("event_id").alias("job_id"), F.col("ts").alias("saved_at"))
    return search.saved_jobs(saved, view(spark, sf_dir, "jobs"), 7, 15)


@query("own_jobs", ctes("jobs") + "SELECT id, user_id, created_at, status FROM jobs WHERE user_id = 42 AND origin = 'user' ORDER BY created_at DESC, id DESC LIMIT 20")
def own_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own ads, newest first."""
    return search.page(view(spark, sf_dir, "jobs").where("user_id = 42 AND origin = 'user'").select("id", "user_id", "created_at", "status"), [F.desc("created_at"), F.desc("id")], 20)


@query("lookup_names", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN (SELECT DISTINCT n_name FROM nation) ON lower('supplier#' || lpad(substr(n_name, 8), 9, '0')) = lower(s_name)")
def lookup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive lookup in a dimension."""
    asked = table(spark, sf_dir, "nation").select("n_name", F.concat(F.lit("SUPPLIER#"), F.lpad(F.substring("n_name", 8, 20), 9, "0")).alias("asked"))
    found = search.lookup(table(spark, sf_dir, "supplier"), asked.select("asked"), "s_name", "asked")
    return found.join(asked, "asked").select("s_suppkey", "s_name", "n_name")


@query("failed_and_waiting", ctes("jobs") + "SELECT id, status, next_retry_at FROM jobs WHERE status IN ('failed', 'retry') ORDER BY next_retry_at DESC NULLS LAST, id DESC LIMIT 40")
def failed_and_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed and waiting jobs, latest first."""
    jobs = view(spark, sf_dir, "jobs").where(F.col("status").isin("failed", "retry")).select("id", "status", "next_retry_at")
    return search.page(jobs, [F.desc_nulls_last("next_retry_at"), F.desc("id")], 40)


_SINCE = "TIMESTAMP '2024-01-10 00:00:00'"
_JOBS_SINCE = "TIMESTAMP '1998-01-01 00:00:00'"


#: Jobs are moved into the posts' years, so that a period holds both.
_MOVED = "INTERVAL '26' YEAR"


@query("period_report", ctes("posts", "jobs").rstrip() + f""", j AS (SELECT kind, category, status, published_at + {_MOVED} AS published_at, created_at + {_MOVED} AS created_at FROM jobs) SELECT metric, '' AS key, n FROM (UNPIVOT (SELECT count(*) AS fetched, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status IN ('not_job', 'resume')) AS not_ads,
count(*) FILTER (status = 'suspicious') AS suspicious, count(*) FILTER (status = 'no_contact') AS no_contact, count(*) FILTER (status = 'low_quality') AS low_quality, count(*) FILTER (status = 'error') AS errors FROM posts WHERE fetched_at >= {_SINCE})
ON COLUMNS(*) INTO NAME metric VALUE n) UNION ALL SELECT metric, '', n FROM (UNPIVOT (SELECT count(*) FILTER (published_at >= {_SINCE}) AS published, count(*) FILTER (status = 'failed' AND created_at >= {_SINCE}) AS failed, count(*) FILTER (status = 'skipped_old') AS skipped_old FROM j) ON COLUMNS(*) INTO NAME metric VALUE n)
UNION ALL SELECT 'category', category, count(*) FROM j WHERE published_at >= {_SINCE} AND kind = 'job' GROUP BY category""")
def period_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: the period report over posts and jobs of the same time."""
    jobs, moved = view(spark, sf_dir, "jobs"), F.expr(_MOVED)
    jobs = jobs.withColumn("published_at", F.col("published_at") + moved).withColumn("updated_at", F.col("created_at") + moved)
    return reports.period(view(spark, sf_dir, "posts"), jobs, F.lit("2024-01-10").cast("timestamp"))


@query("usage_report", ctes("users", "subscriptions", "jobs") + f"""SELECT (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM users WHERE created_at >= date_trunc('day', {T})) AS new_today,
(SELECT count(*) FROM (SELECT user_id, max(o) AS last FROM (SELECT user_id, created_at AS o FROM jobs) GROUP BY 1) WHERE last >= {T} - INTERVAL 7 DAY) AS active_week,
(SELECT count(*) FROM subscriptions WHERE is_active) AS subscriptions, (SELECT count(*) FROM jobs WHERE origin = 'user' AND created_at >= {T} - INTERVAL 7 DAY) AS user_jobs_week""")
def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage report in one row."""
    jobs = view(spark, sf_dir, "jobs")
    last = jobs.groupBy(F.col("user_id").alias("id")).agg(F.max("created_at").alias("last_active_at"))
    users = view(spark, sf_dir, "users").join(last, "id", "left")
    return reports.usage(users, view(spark, sf_dir, "subscriptions"), jobs, now(), F.date_trunc("day", now()))


@query("top_searches", "SELECT json_extract_string(props, '$.k') AS value, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent values inside logged JSON."""
    return reports.top_values(table(spark, sf_dir, "events"), "props", "k", 10)


@query("published_by_source", ctes("jobs") + f"""SELECT s_name AS identifier, count(*) AS n FROM jobs JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON raw_post_id = l_orderkey JOIN supplier ON l_suppkey = s_suppkey
WHERE published_at >= {_JOBS_SINCE} GROUP BY s_name ORDER BY n DESC, identifier LIMIT 10""")
def published_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published per source, a three-table join."""
    posts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("source_id")).distinct()
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("identifier"))
    return reports.published_by_source(view(spark, sf_dir, "jobs"), posts, sources, F.lit("1998-01-01").cast("timestamp"))


@query("source_report", ctes("posts") + """SELECT source, count(*) AS total, count(*) FILTER (fetched_at >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY) AS week, count(*) FILTER (status = 'done') AS jobs, count(*) FILTER (status = 'duplicate') AS duplicates,
count(*) FILTER (status IN ('not_job', 'resume')) AS not_ads, max(coalesce(posted_at, fetched_at)) AS last_post_at FROM posts GROUP BY source""")
def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources at once."""
    return reports.by_source(view(spark, sf_dir, "posts"), F.lit("2024-01-20").cast("timestamp"))


@query("status_counts", ctes("jobs") + "SELECT status, count(*) AS n FROM jobs WHERE status IN ('queued', 'retry', 'failed') GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status."""
    return reports.status_counts(view(spark, sf_dir, "jobs"), ["queued", "retry", "failed"])


@query("queue_overview", ctes("jobs") + f"""SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'retry') AS retry, count(*) FILTER (status = 'failed') AS failed,
count(*) FILTER (status IN ('queued', 'retry') AND (next_retry_at IS NULL OR next_retry_at <= {T})) AS due_now FROM jobs""")
def queue_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue's counts in one pass."""
    s = F.col("status")
    return view(spark, sf_dir, "jobs").agg(*(F.count_if(s == k).alias(k) for k in ("queued", "retry", "failed")), F.count_if(queue.due(now())).alias("due_now"))


@query("tier_published", ctes("jobs") + f"SELECT count(*) AS n FROM jobs WHERE origin = 'aggregator' AND published_at >= {T} - INTERVAL 1 DAY AND status IN ('published', 'expired', 'closed') AND {TIER} = 2")
def tier_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tier's publications in the last day."""
    return queue.published_in_tier(view(spark, sf_dir, "jobs"), 2, now() - F.expr("INTERVAL 1 DAY"))


@query("rolling_day", """SELECT event_id, event_type, user_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS rolling FROM events""")
def rolling_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling 24-hour counts for every event."""
    return reports.rolling_count(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts"), ["user_id", "event_type"], "ts", 86400).drop("ts")


@query("per_local_day", "SELECT event_type AS key, CAST(CAST(timezone('Asia/Tashkent', timezone('UTC', ts)) AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def per_local_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters per local day."""
    return reports.per_local_day(table(spark, sf_dir, "events"), "event_type", "ts", "Asia/Tashkent").withColumn("day", F.col("day").cast("string"))


@query("snapshot_diff", ctes("jobs") + f"""SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.salary_min IS NOT DISTINCT FROM b.salary_min AND a.status = b.status THEN 'same' ELSE 'changed' END AS change,
CASE WHEN a.id IS NULL OR b.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.salary_min IS DISTINCT FROM b.salary_min THEN 'salary_min' END, CASE WHEN a.status <> b.status THEN 'status' END) END AS fields
FROM (SELECT id, salary_min, status FROM jobs WHERE id % 17 <> 0) a FULL JOIN (SELECT id, CASE WHEN id % 3 = 0 THEN salary_min + 1 ELSE salary_min END AS salary_min, CASE WHEN id % 5 = 0 THEN 'closed' ELSE status END AS status FROM jobs WHERE id % 19 <> 0) b ON a.id = b.id""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the fields that changed between two snapshots."""
    jobs = view(spark, sf_dir, "jobs").select("id", "salary_min", "status")
    new = jobs.where("id % 19 <> 0").withColumn("salary_min", F.when(F.col("id") % 3 == 0, F.col("salary_min") + 1).otherwise(F.col("salary_min"))).withColumn("status", F.when(F.col("id") % 5 == 0, "closed").otherwise(F.col("status")))
    return reports.changed_fields(jobs.where("id % 17 <> 0"), new, "id", ["salary_min", "status"])


@query("publish_order", ctes("jobs") + f"SELECT id, row_number() OVER (ORDER BY {TIER}, created_at DESC, id DESC) AS place FROM jobs WHERE status IN ('queued', 'retry') ORDER BY place LIMIT 500")
def publish_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: the head of the queue in its order."""
    head = view(spark, sf_dir, "jobs").where(F.col("status").isin(*queue.SENDABLE)).orderBy(*queue.publish_order()).limit(500)
    from pyspark.sql import Window

    return head.select("id", F.row_number().over(Window.orderBy(*queue.publish_order())).cast("long").alias("place"))


@query("next_due", ctes("jobs") + f"SELECT id, status FROM jobs WHERE status IN ('queued', 'retry') AND (next_retry_at IS NULL OR next_retry_at <= {T}) AND {TIER} < 3 ORDER BY coalesce(next_retry_at, created_at), id LIMIT 1")
def next_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: the next due job while the bottom tier waits."""
    return queue.next_due(view(spark, sf_dir, "jobs"), now(), "fifo", bottom_allowed=False).select("id", "status")


RULES = [("profession", "role1", 3, "role 1"), ("profession", "role2", -3, "role 2"), ("category", "urgent", 2, "urgent"), ("word", "africa", 1, "africa"), ("word", "nation_3", -1, "nation 3"), ("category", "low", -2, "low")]
_RULES_SQL = "rules(field, value, points, label) AS (VALUES " + ", ".join(str(r) for r in RULES) + ")"
_PERIOD = "CASE coalesce(salary_period, 'month') WHEN 'hour' THEN 176.0::DOUBLE WHEN 'day' THEN 22.0 WHEN 'week' THEN 52.0::DOUBLE / 12 WHEN 'month' THEN 1.0 WHEN 'year' THEN 1.0::DOUBLE / 12 END"
_CURRENCY = f"CASE currency WHEN 'UZS' THEN 1.0::DOUBLE WHEN 'USD' THEN {RATE} WHEN 'EUR' THEN {RATE}::DOUBLE * 1.1::DOUBLE WHEN 'RUB' THEN {RATE}::DOUBLE / 90.0 END"
_LO, _HI = (f"{f}(nullif(salary_min, 0)::DOUBLE * {_CURRENCY} * {_PERIOD}, nullif(salary_max, 0)::DOUBLE * {_CURRENCY} * {_PERIOD})" for f in ("least", "greatest"))


@query("priority_score", ctes("jobs").rstrip() + f""", {_RULES_SQL}, hits AS (SELECT id, max(CASE WHEN points > 0 THEN points END) AS high, min(CASE WHEN points < 0 THEN points END) AS low FROM
(SELECT id, 'profession' AS field, profession AS value FROM jobs UNION ALL SELECT id, 'category', category FROM jobs UNION ALL SELECT DISTINCT id, 'word', unnest(regexp_split_to_array(search_text, '[^a-z0-9]+')) FROM jobs) JOIN rules USING (field, value) GROUP BY id),
pay AS (SELECT id, CASE WHEN {_LO} >= 1e9 THEN 2 WHEN {_HI} < 1e6 THEN -2 ELSE 0 END AS p FROM jobs)
SELECT id, CAST(coalesce(high, 0) + coalesce(low, 0) + p AS INT) AS score, CAST(CASE WHEN coalesce(high, 0) + coalesce(low, 0) + p >= 3 THEN 1 WHEN coalesce(high, 0) + coalesce(low, 0) + p <= -2 THEN 3 ELSE 2 END AS INT) AS tier FROM jobs LEFT JOIN hits USING (id) JOIN pay USING (id)""")
def priority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and tiers of all jobs by a rule table and pay in so'm a month."""
    rules = spark.createDataFrame(RULES, "field string, value string, points int, label string")
    return queue.score(view(spark, sf_dir, "jobs"), rules, RATE, 1e9, 1e6).select("id", "score", "tier")


@query("too_old", ctes("jobs", "posts") + f"""SELECT j.id, coalesce(p.posted_at, p.fetched_at) AS seen_at FROM jobs j JOIN posts p ON j.raw_post_id = p.id WHERE j.status IN ('queued', 'retry')
AND epoch(coalesce(p.posted_at, p.fetched_at)) < epoch(TIMESTAMP '2024-01-05 00:00:00') - 3600 * CASE {TIER} WHEN 1 THEN 48 WHEN 2 THEN 24 ELSE 12 END""")
def too_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: waiting jobs beyond their tier's age limit."""
    return queue.too_old(view(spark, sf_dir, "jobs"), view(spark, sf_dir, "posts"), F.lit("2024-01-05").cast("timestamp"), {1: 48, 2: 24, 3: 12})


@query("daily_cap", """SELECT event_id, CAST(CAST(timezone('Asia/Tashkent', timezone('UTC', ts)) AS DATE) AS VARCHAR) AS local_day, row_number() OVER (PARTITION BY event_type, CAST(timezone('Asia/Tashkent', timezone('UTC', ts)) AS DATE) ORDER BY ts, event_id) <= 25 AS accepted FROM events""")
def daily_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6: an acceptance cap for each local day and class."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return queue.daily_cap(rows, "ts", "Asia/Tashkent", 25, ["ts", "event_id"], ["event_type"]).select("event_id", F.col("local_day").cast("string").alias("local_day"), "accepted")


@query("spacing", "SELECT event_id, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id))) AS BIGINT) AS gap_s FROM events")
def spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8: seconds since the publication before."""
    return queue.spacing(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "event_type", "ts", "event_id").select("event_id", "gap_s")


@query("submission_limits", ctes("jobs").rstrip() + """, s AS (SELECT *, CAST(epoch(created_at) AS BIGINT) AS s FROM jobs), w AS (SELECT id, user_id, CAST(coalesce(sum(CASE WHEN status IN ('queued', 'retry') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS waiting,
count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS day_count, CAST(greatest(coalesce(ceil((lag(s) OVER (PARTITION BY user_id ORDER BY s, id) + 43200 * 60 - s) / 60), 0), 0) AS BIGINT) AS minutes_left FROM s)
SELECT *, CASE WHEN waiting >= 3 THEN 'waiting' WHEN day_count >= 2 THEN 'day' WHEN minutes_left > 0 THEN 'gap' ELSE 'ok' END AS verdict FROM w""")
def submission_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of an author's submissions."""
    return queue.submission_limits(view(spark, sf_dir, "jobs"), 3, 2, 43200)
