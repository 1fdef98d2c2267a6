"""Operational reports: partial aggregation before every shuffle, one pass over each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses of posts that turned out not to be ads.
NOT_ADS = ("not_job", "resume", "closed", "opportunity", "no_text")


def _long(rows: DataFrame, **counts: Column) -> DataFrame:
    """One pass, then a row (metric, key, n) for each named count."""
    one = rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("metric"), F.lit("").alias("key"), F.col(k).alias("n")) for k in counts))
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def period(posts: DataFrame, jobs: DataFrame, since: Column) -> DataFrame:
    """Metrics since a moment: posts by outcome, jobs published, failed and too old, published per category."""
    status = F.col("status")
    of_posts = _long(
        posts.where(F.col("fetched_at") >= since),
        fetched=F.lit(True), duplicates=status == "duplicate", not_ads=status.isin(*NOT_ADS), suspicious=status == "suspicious",
        no_contact=status == "no_contact", low_quality=status == "low_quality", errors=status == "error",
    )
    of_jobs = _long(
        jobs,
        published=F.col("published_at") >= since,
        failed=(status == "failed") & (F.col("updated_at") >= since),
        skipped_old=(status == "skipped_old") & (F.col("updated_at") >= since),
    )
    by_category = jobs.where((F.col("published_at") >= since) & (F.col("kind") == "job")).groupBy(F.col("category").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return of_posts.unionByName(of_jobs).unionByName(by_category.select(F.lit("category").alias("metric"), "key", "n"))


def usage(users: DataFrame, subscriptions: DataFrame, jobs: DataFrame, now: Column, today: Column) -> DataFrame:
    """Users, new and active ones, active subscriptions, ads by users in the last week, in one row."""
    week = now - F.expr("INTERVAL 7 DAY")
    a = users.agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("created_at") >= today).alias("new_today"), F.count_if(F.col("last_active_at") >= week).alias("active_week"))
    b = subscriptions.agg(F.count_if("is_active").alias("subscriptions"))
    c = jobs.agg(F.count_if((F.col("origin") == "user") & (F.col("created_at") >= week)).alias("user_jobs_week"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each


def top_values(log: DataFrame, json_col: str, field: str, n: int) -> DataFrame:
    """The most frequent values of a field inside logged JSON; ties by value."""
    value = F.get_json_object(F.col(json_col), f"$.{field}")
    return log.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def published_by_source(jobs: DataFrame, posts: DataFrame, sources: DataFrame, since: Column, n: int = 10) -> DataFrame:
    """Sources of the jobs published since a moment, most first."""
    recent = jobs.where(F.col("published_at") >= since).select("raw_post_id")
    counted = recent.join(posts.select(F.col("id").alias("raw_post_id"), "source_id"), "raw_post_id").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(sources.select(F.col("id").alias("source_id"), "identifier"), "source_id").select("identifier", "n").orderBy(F.desc("n"), "identifier").limit(n)


def by_source(posts: DataFrame, now: Column) -> DataFrame:
    """Every source at once: total, last week, jobs, duplicates, not ads, last post."""
    s = F.col("status")
    return posts.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("fetched_at") >= now - F.expr("INTERVAL 7 DAY")).alias("week"),
        F.count_if(s == "done").alias("jobs"),
        F.count_if(s == "duplicate").alias("duplicates"),
        F.count_if(s.isin(*NOT_ADS)).alias("not_ads"),
        F.max(F.coalesce("posted_at", "fetched_at")).alias("last_post_at"),
    )


def status_counts(rows: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    out = rows.where(F.col("status").isin(*statuses)) if statuses else rows
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def rolling_count(rows: DataFrame, group: list[str], at: str, seconds: int) -> DataFrame:
    """For each row: rows of its group in the ``seconds`` up to it, itself included.

    Events are counted per (group, second) first, so a hot group's window runs over seconds, not rows.
    """
    second = F.unix_timestamp(F.col(at))
    counts = rows.groupBy(*group, second.alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group).orderBy("_s").rangeBetween(-seconds, 0)
    summed = counts.withColumn("rolling", F.sum("_n").over(w)).drop("_n")
    return rows.withColumn("_s", second).join(summed, [*group, "_s"]).drop("_s")


def coverage(parsed: DataFrame, by: list[str]) -> DataFrame:
    """Rows with a phone, an account, a link, an email, or none, rolled up over ``by``."""
    has = {c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0 for c in ("phones", "accounts", "links", "emails")}
    none = ~(has["phones"] | has["accounts"] | has["links"] | has["emails"])
    return parsed.rollup(*by).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(t).alias(f"with_{c}") for c, t in has.items()), F.count_if(none).alias("without"))


def per_local_day(rows: DataFrame, key: str, at: str, zone: str) -> DataFrame:
    """Rows of a key on each local day."""
    return rows.groupBy(F.col(key).alias("key"), F.to_date(F.from_utc_timestamp(F.col(at), zone)).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Names of the fields that differ between two snapshots; rows in one of them only are ``added`` or ``removed``."""
    a = old.select(F.col(key), F.struct(*fields).alias("a"))
    b = new.select(F.col(key), F.struct(*fields).alias("b"))
    names = F.array_compact(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields)))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(names) == 0, "same").otherwise("changed")
    both = a.join(b, key, "full_outer")
    return both.select(key, kind.alias("change"), F.when(kind == "changed", F.array_join(names, ",")).otherwise("").alias("fields"))


def coverage_grid(wanted: DataFrame, assets: DataFrame, slots: int) -> DataFrame:
    """Every wanted folder with slots 1 to ``slots`` and the asset in it; gaps and placeholders first."""
    grid = wanted.select("folder").distinct().withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(slots))))
    ranked = assets.withColumn("slot", F.row_number().over(Window.partitionBy("folder").orderBy("is_placeholder", "path"))).where(F.col("slot") <= slots)
    state = F.when(F.col("path").isNull(), "gap").when(F.col("is_placeholder"), "placeholder").otherwise("real")
    return grid.join(ranked, ["folder", "slot"], "left").select("folder", "slot", "path", state.alias("state"))
