"""Search and list queries over job ads. Every function takes DataFrames and column values; nothing is collected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import stage

REMOTE = "remote"
MOST_WORDS = 6
NORMAL_TIER = 2
#: Days of the rate calendar that are sent to every task.
BROADCAST_DAYS = 100_000


@dataclass(frozen=True)
class Filters:
    """What a reader looks for; an unset field passes everything."""

    category: str | None = None
    profession: str | None = None
    region: str | None = None
    min_salary: int | None = None
    keyword: str | None = None


def tier() -> Column:
    """Priority tier; a job that is not scored yet counts as normal."""
    return F.coalesce(F.col("priority_tier"), F.lit(NORMAL_TIER))


def is_open(now: Column) -> Column:
    """Published jobs (not one-time projects) that have not expired."""
    return (F.col("kind") == "job") & (F.col("status") == "published") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def pays(limit: Column, usd_rate: float) -> Column:
    """Monthly pay in so'm or dollars reaches ``limit`` with either bound; without a number there is no match."""
    rate = F.when(F.col("currency") == "USD", F.lit(float(usd_rate))).otherwise(F.lit(1.0))
    either = F.coalesce(F.col("salary_max") * rate >= limit, F.lit(False)) | F.coalesce(F.col("salary_min") * rate >= limit, F.lit(False))
    return F.col("currency").isin("UZS", "USD") & (F.col("salary_period").isNull() | (F.col("salary_period") == "month")) & either


def words(text: Column, least: int = 2) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) >= least)


def token_index(jobs: DataFrame, id_col: str = "id", text_col: str = "search_text", prefix: int = 2) -> DataFrame:
    """Inverted index ``prefix, token, id``: write it partitioned or clustered by ``prefix``, so that a prefix search reads one part."""
    tokens = jobs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(words(F.col(text_col), 1))).alias("token"))
    return tokens.select(F.substring("token", 1, prefix).alias("prefix"), "token", "id")


def with_words(index: DataFrame, keyword: str, prefix: int = 2) -> DataFrame:
    """Ids whose tokens start with each of the first words of ``keyword`` (two letters at least, prefixes, all of them)."""
    spark = index.sparkSession
    asked = spark.range(1).select(F.explode(F.slice(words(F.lit(keyword)), 1, MOST_WORDS)).alias("word")).distinct()
    n = asked.count()  # at most MOST_WORDS
    near = F.broadcast(asked)
    hits = index.join(near, (F.substring("word", 1, prefix) == F.col("prefix")) & F.col("token").startswith(F.col("word")))
    return hits.groupBy("id").agg(F.count_distinct("word").alias("n")).where((F.col("n") == n) & F.lit(n > 0)).select("id")


def matching(jobs: DataFrame, f: Filters, now: Column, usd_rate: float, index: DataFrame | None = None) -> DataFrame:
    """Open jobs that match the filters."""
    out = jobs.where(is_open(now))
    if f.category:
        out = out.where(F.col("category") == f.category)
    if f.profession:
        out = out.where(F.col("profession") == f.profession)
    if f.region == REMOTE:
        out = out.where("is_remote")
    elif f.region:
        out = out.where(F.col("region") == f.region)
    if f.min_salary:
        out = out.where(pays(F.lit(f.min_salary), usd_rate))
    if f.keyword:
        out = out.join(with_words(index if index is not None else token_index(jobs), f.keyword), "id", "left_semi")
    return out


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in order. A sort with a limit keeps only ``offset + limit`` rows of each task."""
    return rows.orderBy(*order).limit(offset + limit).offset(offset)


def search(jobs: DataFrame, f: Filters, now: Column, usd_rate: float, limit: int = 10, offset: int = 0, index: DataFrame | None = None) -> DataFrame:
    """A page of matching jobs, best tier and newest first, with the number of all matches in ``total``."""
    found = matching(jobs, f, now, usd_rate, index)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    first = page(found, [tier(), F.desc("published_at"), F.desc("id")], limit, offset)
    return first.join(F.broadcast(total))  # one row


def matches(now: Column, usd_rate: float, prefix: str = "s_") -> Column:
    """Does a job row match the filters in the columns ``{prefix}category`` and so on of the same row? Same rules as a search."""

    def unset_or(name: str, test: Column) -> Column:
        return F.col(prefix + name).isNull() | F.coalesce(test, F.lit(False))

    region = F.when(F.col(prefix + "region") == REMOTE, F.col("is_remote")).otherwise(F.col("region") == F.col(prefix + "region"))
    asked = F.slice(words(F.col(prefix + "keyword")), 1, MOST_WORDS)
    tokens = words(F.col("search_text"), 1)
    keyword = (F.size(asked) > 0) & F.forall(asked, lambda w: F.exists(tokens, lambda t: t.startswith(w)))
    return (
        is_open(now)
        & unset_or("category", F.col("category") == F.col(prefix + "category"))
        & unset_or("profession", F.col("profession") == F.col(prefix + "profession"))
        & unset_or("region", region)
        & unset_or("min_salary", pays(F.col(prefix + "min_salary"), usd_rate))
        & unset_or("keyword", keyword)
    )


def as_of_rate(jobs: DataFrame, rates: DataFrame, fallback: float, at: str = "published_at") -> DataFrame:
    """Each job with the latest sane rate (``day, rate``) of its day or before, else ``fallback`` in ``usd_rate``.

    An as-of join without a range join or a sort of the jobs: each day with rates stands for itself and for the days
    up to the next one, so a job finds its rates by the equality of days (days after the last one look there). The
    table of days is as long as the calendar, and goes to every task when its count allows.
    """
    sane = rates.where((F.col("rate") > 1000) & (F.col("rate") < 100000)).select(F.col("day").cast("timestamp").alias("t"), F.col("rate").cast("double").alias("rate"))
    by_day = sane.groupBy(F.to_date("t").alias("d")).agg(F.array_sort(F.collect_list(F.struct("t", "rate"))).alias("told"))
    days = Window.partitionBy(F.lit(0)).orderBy("d")
    known = by_day.withColumn("before", F.lag(F.element_at("told", -1)["rate"]).over(days)).withColumn("until", F.coalesce(F.date_sub(F.lead("d").over(days), 1), F.col("d")))
    known = stage(known.select(F.explode(F.sequence("d", "until")).alias("_day"), "told", "before"), "rate-days")
    size = known.agg(F.count(F.lit(1)).alias("n"), F.max("_day").alias("last")).first()
    named = jobs.withColumn("_of", F.least(F.to_date(F.col(at)), F.lit(size["last"]).cast("date")) if size["n"] else F.to_date(F.col(at)))
    met = named.join(F.broadcast(known) if size["n"] <= BROADCAST_DAYS else known, F.col("_of") == F.col("_day"), "left")
    then = F.array_max(F.filter("told", lambda x: x["t"] <= F.col(at)))["rate"]
    return met.select(*jobs.columns, F.coalesce(then, "before", F.lit(float(fallback))).alias("usd_rate"))


def last_search(log: DataFrame, user: str = "user_id", at: str = "created_at", tie: str = "id", value: str = "filters") -> DataFrame:
    """Each user's latest logged filters."""
    return log.groupBy(user).agg(F.max_by(value, F.struct(at, tie)).alias(value), F.max(at).alias(at))


def saved_jobs(favorites: DataFrame, jobs: DataFrame, user_id: int, limit: int = 10, offset: int = 0) -> DataFrame:
    """A page of a user's saved jobs, latest saved first, with their total."""
    mine = favorites.where(F.col("user_id") == user_id).join(jobs, favorites["job_id"] == jobs["id"])
    total = mine.agg(F.count(F.lit(1)).alias("total"))
    return page(mine.select("id", "category", "status", "saved_at"), [F.desc("saved_at"), F.desc("id")], limit, offset).join(F.broadcast(total))


def open_projects(jobs: DataFrame, now: Column, limit: int = 5, offset: int = 0) -> DataFrame:
    """A page of open one-time projects, newest first, with their number in ``total``."""
    found = jobs.where((F.col("kind") == "project") & (F.col("status") == "published") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return page(found, [F.desc("published_at"), F.desc("id")], limit, offset).join(F.broadcast(total))  # one row


def insert_ignore(new: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet, one of each key."""
    return new.dropDuplicates(key).join(stored.select(*key).distinct(), key, "left_anti")


def lookup(dimension: DataFrame, asked: DataFrame, name: str, asked_name: str) -> DataFrame:
    """Case-insensitive lookup of names in a dimension."""
    left = dimension.withColumn("_key", F.lower(name))
    right = asked.select(F.lower(asked_name).alias("_key"), F.col(asked_name)).distinct()
    return left.join(right, "_key").drop("_key")
