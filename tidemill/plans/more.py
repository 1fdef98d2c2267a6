"""Queries of feeds, submissions and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import contacts, text
from tidemill.operators import extract, queue, submissions
from tidemill.plans.catalog import query
from tidemill.plans.parsing import _ADS, ads
from tidemill.plans.views import NOW, ctes, now, view
from tidemill.session import table
from tidemill.sources import feeds
from tidemill.streaming import posts as steps

T = f"TIMESTAMP '{NOW}'"


@query("feed_records", "SELECT CAST(o_orderkey AS VARCHAR) AS external_id, 'Order ' || o_orderpriority AS title, CAST(floor(o_totalprice) AS BIGINT) AS pay_min, CAST(NULL AS BIGINT) AS pay_max, 'USD' AS currency, 'year' AS period, o_orderdate AS published_at FROM orders WHERE floor(o_totalprice) > 0")
def feed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: payloads of a JSON feed, one for each customer, exploded to the unified schema."""
    one = F.to_json(F.struct(F.col("o_orderkey").alias("guid"), F.concat(F.lit("Order "), F.col("o_orderpriority")).alias("title"), F.floor("o_totalprice").alias("minSalary"), F.unix_timestamp("o_orderdate").alias("pubDate")))
    payloads = table(spark, sf_dir, "orders").where("floor(o_totalprice) > 0").groupBy("o_custkey").agg(F.concat(F.lit('{"jobs":['), F.array_join(F.collect_list(one), ","), F.lit("]}")).alias("payload"))
    return feeds.feed_jobs(payloads, "himalayas").select("external_id", "title", "pay_min", "pay_max", "currency", "period", "published_at")


@query("board_records", "SELECT CAST(o_orderkey AS VARCHAR) AS external_id, CASE o_orderkey % 3 WHEN 0 THEN 'RUB' WHEN 1 THEN 'UZS' ELSE 'EUR' END AS currency, CAST(floor(o_totalprice) AS BIGINT) AS pay_max FROM orders WHERE floor(o_totalprice) > 0")
def board_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: nested pay and old currency codes of a job board."""
    k = F.col("o_orderkey")
    pay = F.struct(F.floor("o_totalprice").alias("to"), F.when(k % 3 == 0, "RUR").when(k % 3 == 1, "SUM").otherwise("EUR").alias("currency"))
    one = F.to_json(F.struct(F.array(F.struct(k.alias("id"), F.lit("x").alias("name"), pay.alias("salary"))).alias("items")))
    return feeds.feed_jobs(table(spark, sf_dir, "orders").where("floor(o_totalprice) > 0").select(one.alias("payload")), "hh").select("external_id", "currency", "pay_max")


@query("mixed_times", "SELECT event_id, date_trunc('second', ts) AS at FROM events")
def mixed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in four formats."""
    ts, k = F.col("ts"), F.col("event_id") % 4
    s = F.unix_timestamp(ts)
    text = F.when(k == 0, s.cast("string")).when(k == 1, (s * 1000).cast("string")).when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.concat(F.lit("Mon, "), F.date_format(ts, "d MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    return table(spark, sf_dir, "events").select("event_id", feeds.parse_time(text).alias("at"))


@query("open_places", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 = 0 THEN true ELSE (c_custkey % 3 <> 0 AND r_name IN ('ASIA', 'EUROPE')) OR (c_custkey % 4 <> 0 AND c_nationkey - 3 <= 5 AND c_nationkey + 3 >= 5) END AS is_open FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def open_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligibility by places and time zones."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k, z = F.col("c_custkey"), F.col("c_nationkey").cast("double")
    places = F.when(k % 3 != 0, F.array("r_name")).otherwise(F.array().cast("array<string>"))
    zones = F.when(k % 4 != 0, F.array(z - 3, z + 3)).otherwise(F.array().cast("array<double>"))
    return rows.select(k.alias("id"), feeds.open_to(places, zones, ["asia", "europe"], 5.0).alias("is_open"))


@query("raw_posts", ctes("jobs") + "SELECT CAST(id AS VARCHAR) AS external_id, 'Position: ' || category || chr(10) || 'Company: ' || source || chr(10) || 'Place: ' || region || CASE WHEN salary_min IS NULL THEN '' ELSE chr(10) || 'Pay: ' || salary_min || ' ' || currency || ' / ' || coalesce(salary_period, 'month') END || chr(10) || 'https://x/' || id AS text FROM jobs")
def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: unified jobs as raw posts."""
    jobs = view(spark, sf_dir, "jobs").select(
        F.col("id").cast("string").alias("external_id"), F.concat(F.lit("https://x/"), F.col("id").cast("string")).alias("url"), F.col("category").alias("title"), F.col("source").alias("company"), F.array("region").alias("locations"),
        F.array().cast("array<double>").alias("timezones"), F.col("salary_min").alias("pay_min"), F.lit(None).cast("long").alias("pay_max"), "currency", F.coalesce("salary_period", F.lit("month")).alias("period"), "published_at", F.lit(None).cast("string").alias("description"),
    )
    return feeds.to_raw(jobs, "x").select("external_id", "text")


@query("page_sources", "SELECT page_id, 'site' AS kind, lower(regexp_extract(regexp_replace(url, '(?i)^(?:https?://)?(?:www\\.)?', ''), '(?i)^([a-z0-9-]+(?:\\.[a-z0-9-]+)+)', 1)) AS identifier FROM pages")
def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and identifiers of given addresses."""
    return feeds.identify_source(table(spark, sf_dir, "pages").select("page_id", "url"), "url").select("page_id", "kind", "identifier")


@query("page_texts", """WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)<li[^>]*>', chr(10) || '• ', 'g'), '(?i)</(?:p|div|h[1-6]|ul|ol|tr|table|section|article)>|<br\\s*/?>', chr(10), 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;?', '&', 'g') AS t FROM a)
SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS text FROM b""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of pages, uncut, as its digest."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(feeds.plain_html(F.col("html"), 1 << 30)).alias("text"))


@query("ad_contacts_all", _ADS + "SELECT id, '@jobs_daily' AS accounts, CAST(0 AS INT) AS n_phones FROM ads")
def ad_contacts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contacts of a post as one struct."""
    found = ads(spark, sf_dir).select("id", contacts.contacts(F.col("text")).alias("c"))
    return found.select("id", F.array_join("c.accounts", ",").alias("accounts"), F.size("c.phones").alias("n_phones"))


@query("post_links", ctes("posts") + "SELECT id, 'https://t.me/' || source || '/' || external_id AS url FROM posts")
def post_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the original posts."""
    return view(spark, sf_dir, "posts").select("id", contacts.post_url(F.col("source"), F.col("external_id")).alias("url"))


_PROFILE = "CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN 'Name: A' || chr(10) || '- Age: 30' || chr(10) || 'Skills - many' || chr(10) || 'I seek work' WHEN 1 THEN 'Name: A' || chr(10) || 'Name: B' || chr(10) || 'Age: 3' || chr(10) || 'I seek work' WHEN 2 THEN 'Name: A' || chr(10) || 'Age: 30' || chr(10) || 'Skills: many' WHEN 3 THEN 'Name: A' || chr(10) || 'Age: 30' || chr(10) || 'Skills: many' || chr(10) || 'I seek work, we pay' WHEN 4 THEN 'name: a' || chr(10) || 'AGE: 30' || chr(10) || 'City: X' || chr(10) || 'skills: y' || chr(10) || 'SEEK WORK' WHEN 5 THEN 'my name: a' || chr(10) || 'Age 30' || chr(10) || 'Skills: many, seek work' END"


@query("seekers", "SELECT c_custkey AS id, c_custkey % 7 IN (0, 4) AS is_seeker FROM customer")
def seekers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts shaped like a job seeker's profile, in all customers' texts: labels that repeat or are too few, no words of a seeker, signs of an employer."""
    texts = spark.sql(f"SELECT c_custkey AS id, {_PROFILE} AS text FROM {{customer}}", customer=table(spark, sf_dir, "customer"))
    return extract.seekers(extract.lines(texts), ["name", "age", "skills", "city"], "seek work", "we pay")


@query("moderation", ctes("jobs") + """SELECT id, CASE WHEN id % 6 = 0 AND id % 10 = 0 THEN 'no_contact' WHEN id % 7 = 0 THEN 'limit' WHEN category = 'urgent' THEN 'rejected' WHEN id % 11 = 0 THEN 'duplicate' WHEN salary_min > 400000 THEN 'review' ELSE 'queued' END AS outcome FROM jobs WHERE origin = 'user'""")
def moderation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of submissions by the first rule that holds."""
    i = F.col("id")
    drafts = view(spark, sf_dir, "jobs").where("origin = 'user'").withColumn("phone", F.when(i % 6 != 0, "+998")).withColumn("account", F.when(i % 10 != 0, "@a"))
    limits = drafts.select("id", F.when(i % 7 == 0, "day").otherwise("ok").alias("verdict"))
    return submissions.moderation(drafts, limits, drafts.where("id % 11 = 0"), extract.content_verdict(F.col("category"), ["urgent"], ["zzz"], []), F.coalesce(F.col("salary_min") > 400000, F.lit(False)))


@query("publication_states", ctes("posts", "jobs") + """SELECT p.id, CASE WHEN j.status = 'published' THEN 'published' WHEN j.status IS NOT NULL THEN 'waiting' WHEN o.status = 'published' THEN 'copy of a published job' WHEN o.status IS NOT NULL THEN 'copy of a waiting job' ELSE p.status END AS state
FROM posts p LEFT JOIN jobs j ON j.raw_post_id = p.id LEFT JOIN jobs o ON p.id % 8 = 4 AND o.raw_post_id = p.id + 1""")
def publication_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what became of each post."""
    posts = view(spark, sf_dir, "posts")
    copies = posts.where("id % 8 = 4").select("id", (F.col("id") + 1).alias("root"))
    return submissions.publication_state(posts, view(spark, sf_dir, "jobs"), copies)


@query("slot_plan")
def slot_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: publication times of the waiting queue with quiet hours; tests compare them with a plain loop."""
    return queue.slot_times(view(spark, sf_dir, "jobs"), NOW, 300, 23, 7)


@query("ready_posts", ctes("posts") + "SELECT id, fetched_at FROM posts WHERE status = 'done' AND fetched_at <= TIMESTAMP '2024-01-05 00:00:00' ORDER BY fetched_at, id LIMIT 40")
def ready_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next batch of posts, oldest first."""
    posts = view(spark, sf_dir, "posts").withColumn("status", F.when(F.col("status") == "done", "new"))
    return steps.ready(posts, F.lit("2024-01-05").cast("timestamp"), 40).select("id", "fetched_at")


@query("release_times", ctes("posts") + "SELECT id, greatest(coalesce(posted_at, fetched_at) + INTERVAL 20 MINUTE, TIMESTAMP '2024-01-05 00:00:00') AS release_at FROM posts")
def release_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: ends of the hold window."""
    return view(spark, sf_dir, "posts").select("id", steps.release_at(F.coalesce("posted_at", "fetched_at"), F.lit("2024-01-05").cast("timestamp")).alias("release_at"))


@query("late_posts", ctes("posts") + "SELECT id FROM posts WHERE epoch(coalesce(posted_at, fetched_at)) < epoch(TIMESTAMP '2024-01-20 00:00:00') - 48 * 3600")
def late_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that are too late to publish."""
    return steps.on_time(view(spark, sf_dir, "posts"), F.lit("2024-01-20").cast("timestamp"), 48)[1].select("id")


@query("due_polls", f"SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 9 = 0 OR 3600 * (s_suppkey % 24) >= greatest(CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 7200 * (s_suppkey % 5) END, 10800)")
def due_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose interval has passed."""
    k = F.col("s_suppkey")
    polled = F.when(k % 9 != 0, F.timestamp_seconds(F.unix_timestamp(now()) - 3600 * (k % 24)))
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), polled.alias("polled_at"), F.when(k % 5 != 0, 7200 * (k % 5)).alias("chosen_s"), F.lit(10800).alias("least_s"))
    return steps.due_sources(rows, now()).select("id")


@query("word_list", "SELECT DISTINCT word, kind FROM (SELECT event_type AS word, 'a' AS kind FROM events WHERE event_type NOT IN ('click', 'view') UNION ALL SELECT event_type || (user_id % 10), 'a' FROM (SELECT event_type, user_id % 10 AS user_id, arg_max(value > 50, ts) AS deleted FROM events GROUP BY 1, 2) WHERE NOT deleted) WHERE true")
def word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word list after edits; the latest edit of a word wins."""
    events = table(spark, sf_dir, "events")
    old = events.select(F.col("event_type").alias("word"), F.lit("a").alias("kind")).where(~F.col("word").isin("click", "view")).distinct()
    edits = events.select(F.concat(F.lit("  "), F.upper("event_type"), (F.col("user_id") % 10).cast("string")).alias("word"), F.lit("a").alias("kind"), (F.col("value") > 50).alias("deleted"), "ts")
    return steps.words_after(old, edits)


@query("search_texts", ctes("jobs") + "SELECT id, lower(category) || chr(10) || lower(source) AS search_text FROM jobs")
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search forms of joined fields, filled in where they are missing."""
    jobs = view(spark, sf_dir, "jobs").withColumn("search_text", F.lit(None).cast("string"))
    return jobs.select("id", F.coalesce("search_text", text.search_text(F.upper("category"), F.col("source"))).alias("search_text"))


@query("touched_users", """WITH u AS (SELECT c_custkey AS id, c_name AS name, TIMESTAMP '2024-01-30 20:00:00' AS active_at, CAST(c_custkey % 3 AS BIGINT) AS trust FROM customer), v AS (SELECT user_id * 2 AS id, max(ts) AS seen, arg_max('n' || (event_id % 2), (ts, event_id)) AS new_name, max(event_id % 2) AS new_trust FROM events GROUP BY 1)
SELECT coalesce(u.id, v.id) AS id, coalesce(new_name, name) AS name, CASE WHEN seen IS NOT NULL AND (active_at IS NULL OR floor(epoch(seen)) - floor(epoch(active_at)) >= 60) THEN seen ELSE active_at END AS active_at, greatest(trust, new_trust) AS trust, (name IS NULL OR (new_name IS NOT NULL AND new_name <> name)) AS changed FROM u FULL JOIN v ON u.id = v.id""")
def touched_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users after their visits."""
    k = F.col("c_custkey")
    users = table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.lit("2024-01-30 20:00:00").cast("timestamp").alias("active_at"), (k % 3).alias("trust"))
    e = F.col("event_id")
    visits = table(spark, sf_dir, "events").select((F.col("user_id") * 2).alias("id"), "ts", e.alias("visit"), F.concat(F.lit("n"), (e % 2).cast("string")).alias("name"), (e % 2).alias("trust"))
    return steps.touched_users(users, visits)
