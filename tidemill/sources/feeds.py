"""Landed feeds to one schema, incremental reads, cursors, idempotent appends, and sinks."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The unified record of a job from any feed.
JOB = "external_id string, url string, title string, company string, locations array<string>, timezones array<double>, pay_min long, pay_max long, currency string, period string, published_at timestamp, description string"
RAW_POST = "id long, source string, external_id string, text string, extra string, posted_at timestamp, fetched_at timestamp"
EXTRA = "links array<struct<text:string,url:string>>, buttons array<struct<text:string,url:string>>, media string, web string"

#: Where the records are in a payload, and which of its fields gives which column, by feed.
FEEDS = {
    "himalayas": ("$.jobs", {"external_id": "guid", "url": "applicationLink", "title": "title", "company": "companyName", "pay_min": "minSalary", "pay_max": "maxSalary", "currency": "currency", "period": "salaryPeriod", "published": "pubDate", "description": "description", "locations": "locationRestrictions", "timezones": "timezoneRestriction"}),
    "remotive": ("$.jobs", {"external_id": "id", "url": "url", "title": "title", "company": "company_name", "published": "publication_date", "description": "description", "location": "candidate_required_location"}),
    "jobicy": ("$.jobs", {"external_id": "id", "url": "url", "title": "jobTitle", "company": "companyName", "pay_min": "salaryMin", "pay_max": "salaryMax", "currency": "salaryCurrency", "period": "salaryPeriod", "published": "pubDate", "description": "jobDescription", "location": "jobGeo"}),
    "remoteok": ("$", {"external_id": "id", "url": "url", "title": "position", "company": "company", "pay_min": "salary_min", "pay_max": "salary_max", "published": "date", "description": "description", "location": "location"}),
    "hh": ("$.items", {"external_id": "id", "url": "alternate_url", "title": "name", "company": "employer.name", "pay_min": "salary.from", "pay_max": "salary.to", "currency": "salary.currency", "published": "published_at", "description": "snippet", "location": "area.name"}),
}
CURRENCIES = {"RUR": "RUB", "SUM": "UZS"}
BLOCK_END = r"(?i)</(?:p|div|h[1-6]|ul|ol|tr|table|section|article)>|<br\s*/?>"
HANDLE = r"^[A-Za-z][A-Za-z0-9_]{3,31}$"


def parse_time(value: Column) -> Column:
    """Epoch seconds or milliseconds, ISO 8601, RFC 822; without a zone it is UTC; what cannot be read is null."""
    number = F.when(value.rlike(r"^\d+(\.\d+)?$"), value.cast("double"))
    epoch = F.timestamp_seconds(F.when(number > 1e12, number / 1000).otherwise(number))
    bare = F.trim(F.regexp_replace(value, r"^[A-Za-z]{3,9},\s*", ""))
    zoned = F.regexp_replace(bare, r"\s(?:GMT|UTC|Z)$", " +0000")
    texts = [F.try_to_timestamp(zoned, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss")]
    iso = F.when(value.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_timestamp(value))
    return F.coalesce(epoch, iso, *texts)


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def unescaped(text: Column) -> Column:
    """Character references decoded by the standard's table, with and without a semicolon; only values with an ampersand leave the JVM."""
    return F.coalesce(_unescaped(F.when(text.contains("&"), text)), text)


def plain_html(value: Column, most: int = 1500) -> Column:
    """Text of a piece of HTML: blocks on lines, list items with a bullet, tags dropped, references decoded, cut at a word."""
    out = F.regexp_replace(F.regexp_replace(value, r"(?i)<li[^>]*>", "\n• "), BLOCK_END, "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?is)<(script|style)[^>]*>.*?</\1>", ""), r"<[^>]+>", "")
    # a space of any kind is one
    out = F.regexp_replace(unescaped(out), r"[\p{Zs}\t]+", " ")
    lines = F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    text = F.array_join(lines, "\n")
    cut = F.regexp_replace(F.substring(text, 1, most), r"\s+\S*$", "")
    return F.when(F.length(text) > most, F.concat(cut, F.lit("…"))).otherwise(text)


def feed_jobs(payloads: DataFrame, feed: str, json_col: str = "payload") -> DataFrame:
    """Records of landed payloads in the unified schema. A record without a title (a legal notice) is skipped; pay without a currency is USD a year."""
    path, fields = FEEDS[feed]
    record = payloads.select(F.explode(F.from_json(F.get_json_object(F.col(json_col), path), "array<string>")).alias("r"))

    def field(name: str) -> Column:
        return F.get_json_object("r", f"$.{fields[name]}") if name in fields else F.lit(None).cast("string")

    def positive(name: str) -> Column:
        number = F.regexp_extract(F.coalesce(field(name), F.lit("")), r"^\d+", 0)
        return F.when(number.rlike("[1-9]"), number.cast("long"))

    lo, hi = positive("pay_min"), positive("pay_max")
    paid = lo.isNotNull() | hi.isNotNull()
    currency = F.upper(field("currency"))
    for old, new in CURRENCIES.items():
        currency = F.when(currency == old, new).otherwise(currency)
    many = F.from_json(field("locations"), "array<string>")
    one = F.when(F.coalesce(field("location"), F.lit("")) != "", F.array(field("location"))).otherwise(F.array().cast("array<string>"))
    out = record.select(
        field("external_id").alias("external_id"), field("url").alias("url"), field("title").alias("title"), field("company").alias("company"),
        F.coalesce(many, one).alias("locations"), F.coalesce(F.from_json(field("timezones"), "array<double>"), F.array().cast("array<double>")).alias("timezones"),
        lo.alias("pay_min"), hi.alias("pay_max"), F.when(paid, F.coalesce(currency, F.lit("USD"))).alias("currency"), F.when(paid, F.coalesce(F.lower(field("period")), F.lit("month" if feed == "hh" else "year"))).alias("period"),
        parse_time(field("published")).alias("published_at"), plain_html(field("description")).alias("description"),
    )
    return out.where("title is not null and title <> ''")


def all_feeds(payloads: DataFrame, feed_col: str = "feed", json_col: str = "payload") -> DataFrame:
    """Jobs of all landed feeds together."""
    parts = [feed_jobs(payloads.where(F.col(feed_col) == f), f, json_col).withColumn("feed", F.lit(f)) for f in FEEDS]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def rss_items(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """Items of RSS 2.0 (``item``) or Atom (``entry``) files: id (digest of guid or link), link, title, text, time."""
    schema = "guid string, id string, link string, title string, description string, encoded string, summary string, content string, pubDate string, published string, updated string"
    rows = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(schema).load(path)
    link = F.coalesce("link", "id")
    return rows.select(
        F.substring(F.sha1(F.coalesce("guid", "id", link)), 1, 20).alias("external_id"), link.alias("url"), "title",
        plain_html(F.coalesce("encoded", "content", "description", "summary")).alias("text"), parse_time(F.coalesce("pubDate", "published", "updated")).alias("published_at"),
    )


def atom_entries(payloads: DataFrame, xml_col: str = "payload") -> DataFrame:
    """Entries of landed Atom feeds, one feed a row: id (digest of the entry's id, else of its link), link (the alternate
    one, else the first), title, text (content over summary), time (published, else updated). What is no feed gives no rows."""
    entry = "id string, title string, summary string, content string, published string, updated string, link array<struct<_href:string,_rel:string>>"
    kind = "entry array<struct<" + entry.replace(" string", ":string").replace("link array", "link:array").replace(", ", ",") + ">>"
    fed = payloads.select(F.from_xml(F.col(xml_col), kind, {"ignoreNamespace": "true"}).alias("f")).select(F.explode("f.entry").alias("e")).select("e.*")
    address = F.coalesce(F.get(F.filter("link", lambda x: x["_rel"] == "alternate"), F.lit(0))["_href"], F.get("link", F.lit(0))["_href"], F.lit(""))
    return fed.select(
        F.substring(F.sha1(F.coalesce(F.when(F.col("id") != "", F.col("id")), address)), 1, 20).alias("external_id"), address.alias("url"), plain_html(F.col("title"), 200).alias("title"),
        plain_html(F.coalesce("content", "summary")).alias("text"), parse_time(F.coalesce("published", "updated")).alias("published_at"),
    )


def sitemap_tree(payloads: DataFrame, roots: Column, child: str, pattern: str, newest: int, loc_col: str = "loc", xml_col: str = "payload") -> DataFrame:
    """The newest pages (``loc, lastmod``) whose address matches ``pattern``, from landed sitemaps: those for which ``roots``
    holds, and the ones they list as children whose address matches ``child`` (one level). Pages of an API are left out."""
    kind = "sitemap array<struct<loc:string>>, url array<struct<loc:string,lastmod:string>>"
    maps = payloads.select(F.col(loc_col).alias("map"), roots.alias("is_root"), F.from_xml(F.col(xml_col), kind, {"ignoreNamespace": "true"}).alias("x"))
    listed = maps.where("is_root").select(F.explode("x.sitemap").alias("s")).select(F.trim("s.loc").alias("map")).where(F.lower("map").rlike(child)).distinct()
    read = maps.where("is_root").unionByName(maps.where("not is_root").join(listed, "map", "left_semi"))
    pages = read.select(F.explode("x.url").alias("u")).select(F.trim("u.loc").alias("loc"), parse_time(F.col("u.lastmod")).alias("lastmod"))
    return pages.where(F.col("loc").rlike(pattern) & ~F.contains(F.col("loc"), F.lit("/api/"))).orderBy(F.desc_nulls_last("lastmod"), "loc").limit(newest)


def skip_history(posts: DataFrame, fetched_up_to: Column) -> DataFrame:
    """Posts at the first start of a worker: what is still new and was fetched up to then is history (``skipped_backfill``)."""
    old = (F.col("status") == "new") & (F.col("fetched_at") <= fetched_up_to)
    return posts.withColumn("status", F.when(old, "skipped_backfill").otherwise(F.col("status")))


def sitemap_pages(spark: SparkSession, path: str, pattern: str, newest: int) -> DataFrame:
    """The newest pages of sitemap files whose address matches a pattern."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return rows.where(F.col("loc").rlike(pattern)).select("loc", parse_time(F.col("lastmod")).alias("lastmod")).orderBy(F.desc_nulls_last("lastmod"), "loc").limit(newest)


def structured_data(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Title and description of pages: the first JSON-LD job posting, else Open Graph, else the title element."""
    html = F.col(html_col)
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    flat = F.flatten(F.transform(blocks, lambda b: F.concat(F.array(b), F.coalesce(F.from_json(F.get_json_object(b, "$.@graph"), "array<string>"), F.array().cast("array<string>")), F.coalesce(F.from_json(b, "array<string>"), F.array().cast("array<string>")))))
    job = F.get(F.filter(flat, lambda b: F.get_json_object(b, "$.@type") == "JobPosting"), F.lit(0))

    def og(name: str) -> Column:
        found = F.regexp_extract(html, rf'(?is)<meta[^>]*property="og:{name}"[^>]*content="([^"]*)"', 1)
        return F.when(found != "", found)

    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    shaped = pages.withColumn("_job", job)
    return shaped.select(
        *[c for c in pages.columns if c != html_col],
        F.coalesce(F.get_json_object("_job", "$.title"), og("title"), F.when(F.trim(title) != "", plain_html(title))).alias("title"),
        F.coalesce(plain_html(F.get_json_object("_job", "$.description")), og("description")).alias("description"),
        F.when(F.col("_job").isNotNull(), "json-ld").when(og("title").isNotNull(), "open graph").otherwise("title").alias("kind"),
    )


def open_to(locations: Column, timezones: Column, words: list[str], offset: float, empty_is_open: bool = True) -> Column:
    """Is a remote job open to a place: a location names an open word, or its offset lies in the zones; with neither given, ``empty_is_open``."""
    named = F.exists(locations, lambda x: F.rlike(F.lower(x), F.lit("|".join(words))))
    zoned = (F.size(timezones) > 0) & (F.array_min(timezones) <= offset) & (F.array_max(timezones) >= offset)
    nothing = (F.size(locations) == 0) & (F.size(timezones) == 0)
    return F.when(nothing, F.lit(empty_is_open)).otherwise(named | zoned)


def to_raw(jobs: DataFrame, source: str) -> DataFrame:
    """Unified jobs as raw posts: labelled lines, the structured record kept in ``extra``."""
    pay = F.when(F.coalesce("pay_min", "pay_max").isNotNull(), F.concat(F.lit("Pay: "), F.concat_ws("-", F.col("pay_min").cast("string"), F.col("pay_max").cast("string")), F.lit(" "), F.col("currency"), F.lit(" / "), F.col("period")))
    text = F.concat_ws("\n", F.concat(F.lit("Position: "), F.col("title")), F.concat(F.lit("Company: "), F.col("company")), F.when(F.size("locations") > 0, F.concat(F.lit("Place: "), F.array_join("locations", ", "))), pay, "description", "url")
    return jobs.select(F.lit(source).alias("source"), "external_id", text.alias("text"), F.to_json(F.struct(F.struct(*jobs.columns).alias("web"))).alias("extra"), F.col("published_at").alias("posted_at"))


def archive(posts: DataFrame, sources: DataFrame) -> DataFrame:
    """Collected posts with their source, in the order of posting."""
    typed = posts.withColumn("extra", F.from_json("extra", EXTRA)) if dict(posts.dtypes).get("extra") == "string" else posts
    return typed.join(sources, "source").withColumn("seen_at", F.coalesce("posted_at", "fetched_at")).orderBy("seen_at", "id")


def fetch_new(rows: DataFrame, cursors: DataFrame, limit: int, key: str = "key", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Rows beyond each source's cursor, oldest first and at most ``limit`` of a source, and the moved cursors.

    The cursor moves only over rows taken and never back; the first read of a source is history (``is_backfill``).
    """
    old = cursors.select(source, F.col("cursor").alias("_cursor"))
    beyond = rows.join(old, source, "left").where(F.col("_cursor").isNull() | (F.col(key) > F.col("_cursor")))
    place = F.row_number().over(Window.partitionBy(source).orderBy(key))
    taken = beyond.withColumn("_place", place).where(F.col("_place") <= limit).withColumn("is_backfill", F.col("_cursor").isNull()).drop("_place", "_cursor")
    newest = taken.groupBy(source).agg(F.max(key).alias("_new"))
    moved = cursors.join(newest, source, "full_outer").select(source, F.greatest("cursor", "_new").alias("cursor"))
    return taken, moved


def flatten_message(messages: DataFrame) -> DataFrame:
    """Exported messages (``id, text, entities, buttons, media``): hidden links and buttons to lists, empty messages dropped."""
    hidden = F.transform(F.filter("entities", lambda e: e["url"].isNotNull()), lambda e: F.struct(F.col("text").substr(e["offset"] + 1, e["length"]).alias("text"), e["url"].alias("url")))
    buttons = F.filter("buttons", lambda b: b["url"].isNotNull())
    full = (F.coalesce("text", F.lit("")) != "") | F.col("media").isNotNull()
    return messages.where(full).select("id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(hidden, F.array().cast("array<struct<text:string,url:string>>")).alias("links"), F.coalesce(buttons, F.array().cast("array<struct<text:string,url:string>>")).alias("buttons"), F.coalesce("media", F.lit("text")).alias("media"))


def identify_source(asked: DataFrame, column: str = "given") -> DataFrame:
    """Kind and identifier of submitted sources: invite, channel, site, feed; what cannot be read has no kind."""
    x = F.trim(F.col(column))
    bare = F.regexp_replace(x, r"(?i)^(?:https?://)?(?:www\.)?", "")
    name = F.regexp_extract(bare, r"(?i)^(?:(?:t|telegram)\.me/(?:s/)?|@)([A-Za-z][A-Za-z0-9_]{3,31})/?(?:\d+)?$", 1)
    invite = F.regexp_extract(bare, r"(?i)^(?:t|telegram)\.me/(?:\+|joinchat/)([A-Za-z0-9_-]{10,})$", 1)
    feed = x.rlike(r"(?i)^https?://[^/?#\s]+/[^?#\s]*(?:rss|feed|atom|\.xml$)")
    site = F.regexp_extract(bare, r"(?i)^([a-z0-9-]+(?:\.[a-z0-9-]+)+)(?:/|$)", 1)
    kind = F.when(invite != "", "invite").when(name != "", "channel").when(feed, "feed").when((site != "") & ~site.rlike(r"(?i)^(?:t|telegram)\.me$"), "site").when(x.rlike(HANDLE), "channel")
    ident = F.when(kind == "invite", invite).when(kind == "channel", F.lower(F.when(name != "", name).otherwise(x))).when(kind == "feed", x).when(kind == "site", F.lower(site))
    return asked.withColumn("kind", kind).withColumn("identifier", ident)


def job_documents(jobs: DataFrame, sources: DataFrame, base: str) -> DataFrame:
    """schema.org documents of jobs whose source allows them, as lines of JSON to write with ``write.text``."""
    allowed = jobs.join(sources.where("allows_markup").select("source"), "source", "left_semi")
    org = F.struct(F.lit("Organization").alias("@type"), F.col("company").alias("name"))
    place = F.struct(F.lit("Place").alias("@type"), F.col("region").alias("address"))
    doc = F.struct(F.lit("https://schema.org/").alias("@context"), F.lit("JobPosting").alias("@type"), F.col("title"), F.date_format("published_at", "yyyy-MM-dd").alias("datePosted"), org.alias("hiringOrganization"), place.alias("jobLocation"), F.concat(F.lit(base), F.col("id").cast("string")).alias("url"))
    return allowed.select("id", F.to_json(doc).alias("value"))


def sitemap_rows(jobs: DataFrame, facets: DataFrame, base: str, newest: int) -> DataFrame:
    """Sitemap rows: the newest jobs and the facet pages with their last change."""
    first = jobs.orderBy(F.desc("published_at"), F.desc("id")).limit(newest).select(F.concat(F.lit(base + "/job/"), F.col("id").cast("string")).alias("loc"), F.col("published_at").alias("lastmod"))
    return first.unionByName(facets.select(F.concat(F.lit(base + "/"), F.col("facet")).alias("loc"), "lastmod"))
