"""User submissions and what became of a post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import contacts
from tidemill.operators import extract


def moderation(drafts: DataFrame, limits: DataFrame, duplicates: DataFrame, rules: Column, needs_review: Column) -> DataFrame:
    """``id, outcome`` of submitted drafts by the first rule that holds: no_contact, limit, rejected, duplicate, review, queued.

    ``limits``: (id, verdict) of the author's limits; ``duplicates``: ids that repeat a recent job.
    """
    rows = drafts.withColumn("_rules", rules).withColumn("_review", needs_review)
    rows = rows.join(limits.select("id", F.col("verdict").alias("_limit")), "id", "left").join(duplicates.select("id").distinct().withColumn("_copy", F.lit(True)), "id", "left")
    outcome = (
        F.when(F.coalesce("phone", "account").isNull(), "no_contact")
        .when(F.coalesce("_limit", F.lit("ok")) != "ok", "limit")
        .when(F.col("_rules") != "ok", "rejected")
        .when(F.col("_copy"), "duplicate")
        .when(F.col("_review"), "review")
        .otherwise("queued")
    )
    return rows.select("id", outcome.alias("outcome"))


def repeated(drafts: DataFrame, jobs: DataFrame, now: Column, days: int) -> DataFrame:
    """Drafts with the same author and digest as a job of the last days that was not rejected."""
    recent = jobs.where((F.col("status") != "rejected") & (F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))).select("user_id", "digest", F.col("id").alias("job_id"))
    return drafts.join(recent, ["user_id", "digest"]).groupBy("id").agg(F.min("job_id").alias("job_id"))


def publication_state(posts: DataFrame, jobs: DataFrame, duplicates: DataFrame) -> DataFrame:
    """``id, state`` of posts: published or waiting as a job of their own, a copy of another (published or waiting), or their own status."""
    own = jobs.select(F.col("raw_post_id").alias("id"), F.col("status").alias("_own"))
    other = duplicates.select("id", "root").join(jobs.select(F.col("raw_post_id").alias("root"), F.col("status").alias("_other")), "root").select("id", "_other")
    rows = posts.select("id", "status").join(own, "id", "left").join(other, "id", "left")
    state = (
        F.when(F.col("_own") == "published", "published")
        .when(F.col("_own").isNotNull(), "waiting")
        .when(F.col("_other") == "published", "copy of a published job")
        .when(F.col("_other").isNotNull(), "copy of a waiting job")
        .otherwise(F.col("status"))
    )
    return rows.select("id", state.alias("state"))


def source_overview(sources: DataFrame, posts: DataFrame, name: str = "source") -> DataFrame:
    """Every source with its number of posts and the time of the newest, sources without posts included."""
    counted = posts.groupBy(name).agg(F.count(F.lit(1)).alias("posts"), F.max(F.coalesce("posted_at", "fetched_at")).alias("newest"))
    return sources.join(counted, name, "left").withColumn("posts", F.coalesce("posts", F.lit(0)))


def current_rows(job: DataFrame, posts: DataFrame) -> DataFrame:
    """All posts behind a job (parts of an album): those linked by ``job_id`` and the primary one, once each."""
    linked = posts.join(job.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    primary = posts.join(job.select(F.col("raw_post_id").alias("id")), "id", "left_semi")
    return linked.unionByName(primary).dropDuplicates(["id"])


def listed_sources(sources: DataFrame) -> DataFrame:
    """``list, source`` of the lists that a source (``source, status, enabled``) is on: polled, pending, visible (all but deleted ones)."""
    on = F.array(
        F.when((F.col("status") == "active") & F.col("enabled"), F.lit("polled")),
        F.when(F.col("status") == "pending", F.lit("pending")),
        F.when(F.col("status") != "deleted", F.lit("visible")),
    )
    return sources.select(F.explode(F.array_compact(on)).alias("list"), "source")


def recipients(users: DataFrame) -> DataFrame:
    """Ids of the users that a message to all goes to: those that are not banned."""
    return users.where(~F.col("is_banned")).select("id")


def clean_field(value: Column, most: int) -> Column:
    """A typed field without blank lines and outer spaces; null if nothing is left or more than ``most`` characters are."""
    lines = F.filter(F.transform(F.split(value, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    text = F.array_join(lines, "\n")
    return F.when((text != "") & (F.length(text) <= most), text)


def shared_phone(raw: Column) -> Column:
    """The number of a shared contact as +998XXXXXXXXX; null for numbers of other countries."""
    digits = F.regexp_replace(raw, r"\D", "")
    return F.when(digits.rlike(r"^998\d{9}$"), F.concat(F.lit("+"), digits))


def typed_contact(text: Column) -> Column:
    """``struct<phone, account>`` of a typed contact, the account in its own spelling; a bare name is an account where there is no phone."""
    phone = F.get(contacts.phones(text), F.lit(0))
    written = F.regexp_extract(text, contacts.ACCOUNT, 1)
    linked = F.regexp_extract(text, contacts.ACCOUNT, 2)
    bare = F.regexp_extract(F.trim(text), contacts.BARE_ACCOUNT, 1)
    name = F.when(written != "", written).when(linked != "", linked).when((bare != "") & phone.isNull(), bare)
    return F.struct(phone.alias("phone"), F.concat(F.lit("@"), name).alias("account"))


def form_fields(drafts: DataFrame, votes: DataFrame, categories: list[str], fallback: str = "other") -> DataFrame:
    """Drafts of a form in the shape of parsed posts: pay parsed, remote is no region, and the profession that was voted
    for (``id, category, profession``) kept only where its category is the draft's."""
    voted = votes.select("id", F.col("category").alias("_category"), F.col("profession").alias("_profession"))
    rows = drafts.withColumn("_pay", extract.pay_value(F.col("salary"))).join(voted, "id", "left")
    remote = F.col("region") == "remote"
    return rows.select(
        "id", "title", F.col("_pay.lo").alias("salary_min"), F.col("_pay.hi").alias("salary_max"), F.col("_pay.currency").alias("currency"), F.col("_pay.period").alias("salary_period"),
        F.when(~remote, F.col("region")).alias("region"), remote.alias("is_remote"),
        F.when(F.col("category").isin(*categories), F.col("category")).otherwise(fallback).alias("category"), F.when(F.col("_category") == F.col("category"), F.col("_profession")).alias("profession"),
    )
