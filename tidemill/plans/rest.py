"""Lists of sources and users, drafts of a form, budgets, landed Atom feeds and sitemaps, stored shapes; each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import dedup, extract, search, submissions
from tidemill.plans.catalog import query
from tidemill.plans.views import NOW, ctes, now, view
from tidemill.session import table
from tidemill.sources import feeds

_STATUS = "CASE s_suppkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'deleted' ELSE 'active' END"


@query("listed_sources", f"WITH s AS (SELECT s_name AS source, {_STATUS} AS status, s_acctbal > 0 AS enabled FROM supplier) SELECT 'polled' AS list, source FROM s WHERE status = 'active' AND enabled UNION ALL SELECT 'pending', source FROM s WHERE status = 'pending' UNION ALL SELECT 'visible', source FROM s WHERE status <> 'deleted'")
def listed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources to poll, waiting for approval, and visible."""
    return submissions.listed_sources(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("source"), F.expr(_STATUS).alias("status"), (F.col("s_acctbal") > 0).alias("enabled")))


@query("recipients", ctes("users") + "SELECT id FROM users WHERE NOT is_banned")
def recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who gets a message to all."""
    return submissions.recipients(view(spark, sf_dir, "users"))


@query("typed_contacts", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 < 2 THEN '+99890' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '5') END AS phone, CASE c_custkey % 4 WHEN 3 THEN NULL WHEN 0 THEN NULL ELSE '@User_' || c_custkey END AS account, CASE WHEN c_custkey % 2 = 0 THEN '+99890' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '5') END AS shared, CASE WHEN length(c_name) + 2 + length(c_mktsegment) <= 28 THEN c_name || chr(10) || c_mktsegment END AS field FROM customer")
def typed_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phone, a phone and an account, a bare name, or neither; a shared number; a field of 27 characters at most."""
    k = F.col("c_custkey").cast("string")
    seven = F.lpad((F.col("c_custkey") % 10_000_000).cast("string"), 7, "5")
    phone = F.concat(F.lit("90 "), F.substring(seven, 1, 3), F.lit("-"), F.substring(seven, 4, 2), F.lit("-"), F.substring(seven, 6, 2))
    kind = F.col("c_custkey") % 4
    line = F.when(kind == 0, phone).when(kind == 1, F.concat(phone, F.lit(", @User_"), k)).when(kind == 2, F.concat(F.lit(" User_"), k, F.lit(" "))).otherwise(F.concat(F.lit("ask for "), k))
    shared = F.concat(F.when(F.col("c_custkey") % 2 == 0, "+998 (90) ").otherwise("+7 (90) "), seven)
    field = F.concat(F.lit("\n  "), F.col("c_name"), F.lit(" \n\n "), F.col("c_mktsegment"), F.lit("\n"))
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), submissions.typed_contact(line).alias("c"), submissions.shared_phone(shared).alias("shared"), submissions.clean_field(field, 27).alias("field"))
    return found.select("id", "c.phone", "c.account", "shared", "field")


_KIND = "CASE WHEN currency = 'UZS' THEN {a} WHEN currency = 'USD' THEN {b} END"
_OF_ROLE = "CASE CAST(substr(profession, 5) AS INT) % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'urgent' ELSE 'high' END"


@query(
    "form_drafts",
    ctes("jobs")
    + f"SELECT id, 'Clerk ' || coalesce(profession, 'wanted') AS title, {_KIND.format(a='(1 + user_id % 9) * 1000000', b='300 + user_id % 9')} AS salary_min, {_KIND.format(a='(1 + user_id % 9) * 1000000', b='500 + user_id % 9')} AS salary_max, {_KIND.format(a=chr(39) + 'UZS' + chr(39), b=chr(39) + 'USD' + chr(39))} AS currency, {_KIND.format(a=chr(39) + 'month' + chr(39), b=chr(39) + 'week' + chr(39))} AS salary_period, CASE WHEN NOT is_remote THEN region END AS region, is_remote, CASE WHEN category IN ('low', 'urgent', 'high') THEN category ELSE 'other' END AS category, CASE WHEN {_OF_ROLE} = category THEN profession END AS profession FROM jobs",
)
def form_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of a form as parsed posts: pay from the typed words, the profession by votes over the title."""
    jobs = view(spark, sf_dir, "jobs")
    worded = _KIND.format(a="'Salary ' || CAST(1 + user_id % 9 AS STRING) || ' mln so\\'m monthly'", b="'$' || CAST(300 + user_id % 9 AS STRING) || ' - ' || CAST(500 + user_id % 9 AS STRING) || ' per week'")
    title = F.concat(F.lit("Clerk "), F.coalesce("profession", F.lit("wanted")))
    drafts = jobs.select("id", title.alias("title"), F.coalesce(F.expr(worded), F.lit("by agreement")).alias("salary"), F.when(F.col("is_remote"), "remote").otherwise(F.col("region")).alias("region"), "category")
    roles = [(f"role{k}", ["low", "urgent", "high"][k % 3]) for k in range(7)]
    names = spark.createDataFrame([(r, r) for r, _ in roles], "name string, key string")
    hits = extract.named(drafts, names, text_col="title")
    votes = extract.category_vote(hits, hits.where("false"), spark.createDataFrame(roles, "key string, category string"))
    return submissions.form_fields(drafts, votes, ["low", "urgent", "high"])


@query("budgets", "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN (1 + o_custkey % 9) * 1000000 WHEN 1 THEN 300 WHEN 2 THEN 2000000 END AS amount, CASE o_orderkey % 5 WHEN 0 THEN 'UZS' WHEN 1 THEN 'USD' WHEN 2 THEN 'UZS' END AS currency, CASE o_orderkey % 5 WHEN 0 THEN (1 + o_custkey % 9) || ' 000 000 so''m' WHEN 1 THEN '300 – 500 USD' WHEN 2 THEN '2 000 000 so''mgacha' WHEN 3 THEN 'as agreed' ELSE 'Negotiable' END AS shown FROM orders")
def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets as amounts: from, between, up to, as typed, not given."""
    line = F.expr("CASE o_orderkey % 5 WHEN 0 THEN cast(1 + o_custkey % 9 as string) || ' mln so\\'m' WHEN 1 THEN '$300 - 500 per month' WHEN 2 THEN 'up to 2 000 000 so\\'m' WHEN 3 THEN ' as agreed ' END")
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), extract.budget(line, "Negotiable", {"UZS": "so'm"}).alias("b"))
    return found.select("id", "b.*")


@query("window_entries", ctes("posts") + "SELECT id, coalesce(posted_at, fetched_at) AS entered_at FROM posts WHERE status IN ('done', 'duplicate') AND text IS NOT NULL AND coalesce(posted_at, fetched_at) >= TIMESTAMP '2024-01-03 12:00:00'")
def window_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored entries of the window, read again."""
    posts = view(spark, sf_dir, "posts").withColumn("dedup_text", F.when(F.col("status").isin("done", "duplicate"), F.col("text")))
    return dedup.reloaded(posts, F.lit("2024-01-03 12:00:00").cast("timestamp")).select("id", "entered_at")


@query("skipped_history", ctes("posts") + "SELECT id, CASE WHEN id % 3 <> 0 THEN status WHEN fetched_at <= TIMESTAMP '2024-01-04 00:00:00' THEN 'skipped_backfill' ELSE 'new' END AS status FROM posts")
def skipped_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that are new when a worker first starts are history."""
    posts = view(spark, sf_dir, "posts").withColumn("status", F.when(F.col("id") % 3 == 0, "new").otherwise(F.col("status")))
    return feeds.skip_history(posts, F.lit("2024-01-04 00:00:00").cast("timestamp")).select("id", "status")


@query("archive_scan", ctes("posts") + "SELECT p.id, p.source, s_name AS title, coalesce(posted_at, fetched_at) AS seen_at, CASE WHEN p.id % 2 = 0 THEN 'photo' END AS media FROM posts p JOIN supplier ON p.source = 'src' || s_suppkey")
def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the archive of posts with typed extras and their sources, in the order of posting."""
    posts = view(spark, sf_dir, "posts").withColumn("extra", F.when(F.col("id") % 2 == 0, '{"media": "photo"}').otherwise('{"links": []}'))
    sources = table(spark, sf_dir, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("source"), F.col("s_name").alias("title"))
    return feeds.archive(posts, sources).select("id", "source", "title", "seen_at", F.col("extra.media").alias("media"))


@query("atom_feeds", "SELECT substr(sha1('tag:' || page_id || ':' || k), 1, 20) AS external_id, 'https://a.uz/' || CASE k WHEN 0 THEN 'read/' ELSE 'one/' END || page_id AS url, 'Clerk & co ' || k AS title, CASE k WHEN 0 THEN 'Full ' || page_id ELSE 'Short' END AS text, TIMESTAMP '2024-01-01 10:00:00' + INTERVAL 1 MINUTE * k AS published_at FROM pages CROSS JOIN (VALUES (0), (1)) AS t(k)")
def atom_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: a landed Atom feed of two entries for each page: alternate over first link, content over summary, published over updated."""
    k = F.col("page_id").cast("string")
    one = F.concat(F.lit("<entry><id>tag:"), k, F.lit(":0</id><title>Clerk &amp;amp; co 0</title><link rel='self' href='https://a.uz/self/"), k, F.lit("'/><link rel='alternate' href='https://a.uz/read/"), k, F.lit("'/><summary>Short</summary><content>&lt;p&gt;Full "), k, F.lit("&lt;/p&gt;</content><published>2024-01-01T10:00:00Z</published><updated>2024-01-02T10:00:00Z</updated></entry>"))
    two = F.concat(F.lit("<entry><id>tag:"), k, F.lit(":1</id><title>Clerk &amp;amp; co 1</title><link href='https://a.uz/one/"), k, F.lit("'/><link href='https://a.uz/two'/><summary>Short</summary><updated>2024-01-01T10:01:00Z</updated></entry>"))
    return feeds.atom_entries(table(spark, sf_dir, "pages").select(F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><title>t</title>"), one, two, F.lit("</feed>")).alias("payload")))


@query("sitemap_tree", "SELECT 'https://s.uz/vacancy/' || c_custkey AS loc, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * c_custkey AS lastmod FROM customer WHERE c_custkey // 50 % 3 <> 0 AND c_custkey % 2 = 0 ORDER BY 2 DESC, 1 LIMIT 20")
def sitemap_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the newest 20 vacancy pages (a top-k) of landed sitemaps of 50 pages each, by way of index sitemaps; every third sitemap is of news."""
    c = F.col("c_custkey")
    part = F.floor(c / 50)
    name = F.concat(F.lit("https://s.uz/"), F.when(part % 3 == 0, "news").otherwise("Vacancies"), F.lit("-"), part.cast("string"), F.lit(".xml"))
    stamp = F.date_format(F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, cast(c_custkey as int))"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.concat(F.lit("<url><loc> https://s.uz/"), F.when(c % 2 == 0, "").otherwise("api/"), F.lit("vacancy/"), c.cast("string"), F.lit("</loc><lastmod>"), stamp, F.lit("</lastmod></url>"))
    sheet, index = "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>", "<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>"
    children = table(spark, sf_dir, "customer").groupBy(name.alias("loc"), part.alias("part")).agg(F.concat(F.lit(sheet), F.array_join(F.collect_list(url), ""), F.lit("</urlset>")).alias("payload"))
    entry = F.concat(F.lit("<sitemap><loc>"), F.col("loc"), F.lit("</loc></sitemap>"))
    parents = children.groupBy(F.floor(F.col("part") / 50).alias("k")).agg(F.concat(F.lit(index), F.array_join(F.collect_list(entry), ""), F.lit("</sitemapindex>")).alias("payload"))
    landed = children.select("loc", "payload", F.lit(False).alias("root")).unionByName(parents.select(F.concat(F.lit("https://s.uz/sitemap-"), F.col("k").cast("string"), F.lit(".xml")).alias("loc"), "payload", F.lit(True).alias("root")))
    return feeds.sitemap_tree(landed, F.col("root"), "vacanc", r"/vacancy/\d+$", 20)


@query("open_projects", ctes("jobs") + f", o AS (SELECT * FROM jobs WHERE kind = 'project' AND status = 'published' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')) SELECT id, published_at, (SELECT count(*) FROM o) AS total FROM o ORDER BY published_at DESC, id DESC LIMIT 5 OFFSET 5")
def open_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of open one-time projects, with their total."""
    return search.open_projects(view(spark, sf_dir, "jobs"), now(), 5, 5).select("id", "published_at", "total")


@query("own_accounts", "SELECT DISTINCT s_name AS source, '@' || unnest(['name_' || s_suppkey, 'extra_' || s_suppkey]) AS account FROM supplier")
def own_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's own accounts: its identifier and its list, in one spelling, once."""
    k = F.col("s_suppkey").cast("string")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("source"), F.concat(F.lit("Name_"), k).alias("identifier"), F.array(F.concat(F.lit("@EXTRA_"), k), F.concat(F.lit("@name_"), k)).alias("own_usernames"))
    return extract.own_accounts(rows)


@query("stored_posts", "SELECT doc_id AS id, substr(text, 1, 200) AS title, source AS company, CASE WHEN doc_id % 2 = 0 THEN lang END AS phone, CAST(NULL AS VARCHAR) AS account, md5(substr(text, 1, 4000)) AS description FROM documents")
def stored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed posts in the stored shape, with its length limits and the first of each contact."""
    none = F.array().cast("array<string>")
    parsed = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("source").alias("company"), F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(none).alias("phones"), none.alias("accounts"), "text")
    return extract.stored_columns(parsed).withColumn("description", F.md5("description"))
