"""Queries of extraction and classification. Ads are worded from orders, so that what is parsed can be held against the numbers it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.pay import pay_once
from tidemill.operators import extract
from tidemill.plans.catalog import query
from tidemill.plans.views import ctes, view
from tidemill.session import spread, table

# an ad's wording: label lines, pay, place words, list items, trailing tags
_AD = """'Position: ' || category || ' ' || coalesce(profession, 'worker') || chr(10) || 'Company: ' || source || chr(10) || 'Salary: ' || CASE WHEN salary_min IS NULL THEN 'up to ' || CAST(salary_max AS VARCHAR(20)) WHEN salary_max IS NULL THEN 'from ' || CAST(salary_min AS VARCHAR(20)) ELSE CAST(salary_min AS VARCHAR(20)) || ' - ' || CAST(salary_max AS VARCHAR(20)) END || ' ' || lower(currency) || CASE WHEN salary_period IS NULL THEN '' ELSE ' per ' || salary_period END || chr(10)
|| 'Place: ' || region || ', ' || lower(source) || chr(10) || 'Duties:' || chr(10) || '- count things' || chr(10) || '- sell ' || category || chr(10) || chr(10) || 'Deadline: ' || substring(CAST(created_at AS VARCHAR(30)), 1, 10) || chr(10) || 'Join our channel @jobs_daily' || chr(10) || '#job #' || replace(region, ' ', '_')"""
_ADS = ctes("jobs").rstrip() + f", ads AS (SELECT *, {_AD} AS text FROM jobs WHERE coalesce(salary_min, salary_max) IS NOT NULL) "


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worded ads of all jobs with pay."""
    return spark.sql(f"SELECT *, {_AD} AS text FROM {{jobs}} WHERE coalesce(salary_min, salary_max) IS NOT NULL", jobs=view(spark, sf_dir, "jobs", wide=True))


@query("pay_ranges", _ADS + """, told AS (SELECT *, CASE WHEN salary_period = 'day' THEN 'day' ELSE 'month' END AS period, coalesce(salary_min, salary_max) AS low, coalesce(salary_max, salary_min) AS high FROM ads)
SELECT id, salary_min AS lo, salary_max AS hi, currency, period FROM told WHERE CASE currency WHEN 'UZS' THEN low >= CASE period WHEN 'day' THEN 30000 ELSE 500000 END AND high <= CASE period WHEN 'day' THEN 5000000 ELSE 200000000 END
WHEN 'RUB' THEN period = 'day' OR (low >= 5000 AND high <= 2000000) ELSE low >= CASE period WHEN 'day' THEN 5 ELSE 50 END AND high <= CASE period WHEN 'day' THEN 1000 ELSE 30000 END END""")
def pay_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay ranges read back from the ads' wording, insane ones left out."""
    found = ads(spark, sf_dir).select("id", pay_once(F.col("text")).alias("p")).where("coalesce(p.lo, p.hi) is not null")
    return found.select("id", "p.lo", "p.hi", "p.currency", "p.period")


@query("deadlines", _ADS + "SELECT id, substring(CAST(created_at AS VARCHAR), 1, 10) AS deadline FROM ads")
def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates after a deadline word."""
    return ads(spark, sf_dir).select("id", extract.deadline(F.col("text"), 2024).cast("string").alias("deadline"))


@query("titles", _ADS + "SELECT id, category || ' ' || coalesce(profession, 'worker') AS title FROM ads")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: titles from labelled lines."""
    return extract.title(extract.lines(ads(spark, sf_dir)), "position|vacancy", "hiring|we look for", ["role"])


@query("companies", _ADS + "SELECT id, source AS company FROM ads")
def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies from labelled lines that agree."""
    return extract.company(extract.lines(ads(spark, sf_dir)), "company|employer")


@query("duties", _ADS + "SELECT id, 'count things, sell ' || category AS value FROM ads")
def duties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list lines that follow a label."""
    return ads(spark, sf_dir).select("id", extract.field_of(F.col("text"), "duties").alias("value")).where("value is not null")


@query("stripped_ads", _ADS + "SELECT id, md5(replace(text, chr(10) || '#job #' || replace(region, ' ', '_'), '')) AS text FROM ads")
def stripped_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines out by rules of the source; a line with a contact that is nowhere else comes back."""
    posts = ads(spark, sf_dir)
    rules = spark.createDataFrame([("part", "Join our channel"), ("cut", "^Apply only")], "kind string, pattern string").crossJoin(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"))))
    return extract.stripped(posts, rules).select("id", F.md5("text").alias("text"))


@query("ad_contacts", _ADS + "SELECT id, 'Join our channel @jobs_daily' AS line FROM ads")
def ad_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that offer a channel."""
    return extract.ad_contact_lines(extract.lines(ads(spark, sf_dir)), "Join our channel|advertising").select("id", "line")


@query("place_votes", _ADS + "SELECT id, region, CAST(CASE WHEN position(' ' IN region) > 0 THEN 3 ELSE 4 END AS BIGINT) AS n, false AS multi FROM ads")
def place_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region with most mentions by a join with a table of names: company, place, region, and a tag that is one word."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.lower("r_name").alias("key")
    names = region.select(F.lower("r_name").alias("name"), key).unionByName(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name").alias("name"), key))
    return extract.place_vote(extract.named(ads(spark, sf_dir), names))


@query("category_votes", _ADS + "SELECT id, CASE WHEN profession IN ('role1', 'role2', 'role3') THEN 'office' WHEN profession IN ('role4', 'role5') THEN 'field' ELSE 'other' END AS category, CASE WHEN profession IN ('role1', 'role2', 'role3', 'role4', 'role5') THEN profession END AS profession FROM ads")
def category_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: categories by dictionary hits in title and text."""
    posts = ads(spark, sf_dir)
    kinds = spark.createDataFrame([("role1", "office"), ("role2", "office"), ("role3", "office"), ("role4", "field"), ("role5", "field")], "key string, category string")
    names = kinds.select(F.col("key").alias("name"), "key")
    heads = posts.select("id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("text"))
    voted = extract.category_vote(extract.named(heads, names, 1), extract.named(posts, names, 1), kinds)
    return posts.select("id").join(voted, "id", "left").select("id", F.coalesce("category", F.lit("other")).alias("category"), "profession")


MARKERS = {
    "closed": ["closed", "werden"], "resume": ["pour", "curriculum"], "scam": ["password"], "scam_exceptions": ["password reset"], "opportunity_strong": ["volunteer", "muy"], "opportunity_exceptions": ["para"],
    "not_job_strong": ["nicht"], "opportunity": ["grant", "des"], "ad": ["channel", "une", "los"], "job": ["the", "was", "der", "die"],
}
_HAS = {k: "len(list_filter(" + str(v) + ", lambda m: regexp_matches(" + ("replace(lower(text), 'password reset', ' ')" if k == "scam" else "lower(text)") + ", '(^|[^\\p{L}\\p{N}''])' || m)))" for k, v in MARKERS.items()}


@query("post_kinds", "WITH n AS (SELECT doc_id AS id, text, source, " + ", ".join(f"{v} AS n_{k}" for k, v in _HAS.items()) + """ FROM documents) SELECT id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'no_text' WHEN n_closed > 0 THEN 'closed' WHEN n_resume > 0 THEN 'resume' WHEN n_scam > 0 THEN 'suspicious'
WHEN n_opportunity_strong > 0 AND n_opportunity_exceptions = 0 THEN 'opportunity' WHEN n_not_job_strong > 0 THEN 'not_job' WHEN source = 'src2' OR (source = 'src4' AND source <> 'src1') THEN 'not_job'
WHEN source <> 'src1' AND n_job < 4 AND n_opportunity > 0 THEN 'opportunity' WHEN source <> 'src1' AND n_job < 4 AND n_ad > 0 AND n_ad >= n_job THEN 'not_job' WHEN source = 'src1' OR n_job >= 2 THEN 'job' ELSE 'not_job' END AS kind FROM n""")
def post_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: kinds of posts by the first rule that holds: markers, their exceptions, and tags, which are the sources here."""
    source = F.col("source")
    kind = extract.classify(F.lower("text"), MARKERS, tags=F.array(source), job_tags=["src1"], other_tags=["src2"], needs_tag=source == "src4")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), kind.alias("kind"))


@query("feature_tags", "SELECT doc_id AS id, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{L}])the($|[^\\p{L}])') THEN 'the' END, CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{L}])und($|[^\\p{L}])') THEN 'und' END) AS tags FROM documents")
def feature_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by patterns; the given texts hold no negation word."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(extract.tags(F.col("text"), {"the": r"(?<!\p{L})the(?!\p{L})", "und": r"(?<!\p{L})und(?!\p{L})"}, "kein"), ",").alias("tags"))


@query("assembled", _ADS + """SELECT id, round(least(CASE WHEN id % 7 = 0 THEN 0.0 WHEN id % 2 = 0 THEN 0.2 ELSE 0.35 END + CASE WHEN id % 3 = 0 THEN 0.35 ELSE 0 END + 0.1 + 0.1 + 0.1, 1.0), 2)::DOUBLE AS confidence, false AS low_quality FROM ads""")
def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of parsed fields."""
    i = F.col("id")
    fields = ads(spark, sf_dir).select("id", F.when(i % 7 != 0, F.col("category")).alias("title"), (i % 2 == 0).alias("title_guessed"), F.when(i % 3 == 0, "+998").alias("phone"), F.lit(None).cast("string").alias("account"), "salary_min", "salary_max", "region", F.col("source").alias("company"))
    return extract.assembled(fields).select("id", "confidence", "low_quality")


@query("translated_titles", _ADS + "SELECT id, CASE WHEN category = 'urgent' THEN 'very soon' ELSE replace(replace(category, 'not specified', 'any'), 'medium', 'middle') END AS translated FROM ads")
def translated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by a dictionary, else word by word, longest first."""
    exact = spark.createDataFrame([("urgent", "very soon")], "folded string, translated string")
    return extract.translated(ads(spark, sf_dir).select("id", F.col("category").alias("title")), exact, [("medium", "middle"), ("not", "no"), ("not specified", "any")]).select("id", "translated")


@query("site_overlay", _ADS + """SELECT id, CAST(CASE WHEN (CASE WHEN id % 2 = 0 THEN 'year' ELSE salary_period END) = 'year' THEN CAST(round_even(CASE WHEN id % 2 = 0 THEN coalesce(salary_min * 2, salary_min) ELSE salary_min END / 12.0, 0) AS BIGINT) ELSE salary_min END AS BIGINT) AS salary_min,
CASE WHEN id % 2 = 0 OR salary_period = 'year' THEN 'month' ELSE salary_period END AS salary_period FROM ads""")
def site_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's fields win, yearly pay becomes monthly."""
    posts = ads(spark, sf_dir).select("id", "salary_min", "salary_period")
    site = posts.where("id % 2 = 0").select("id", (F.col("salary_min") * 2).alias("salary_min"), F.lit("year").alias("salary_period"))
    return extract.overlay(posts, site, ["salary_min", "salary_period"])


@query("cached_answers", _ADS + "SELECT id, CASE WHEN id % 3 = 0 THEN 'answer ' || category ELSE category END AS title, id % 3 = 0 AS was_enriched FROM ads")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers for unsure rows, found by the digest of version and masked text."""
    posts = ads(spark, sf_dir).select("id", F.col("category").alias("title"), F.col("source").alias("company"), "text", F.when(F.col("id") % 3 == 0, 0.5).otherwise(0.9).alias("confidence"), F.lit(False).alias("low_quality"))
    stored = posts.select(F.sha2(F.concat_ws("|", F.lit("v1"), F.col("text")), 256).alias("key"), F.concat(F.lit("answer "), F.col("title")).alias("title"), "company").dropDuplicates(["key"])
    return extract.enriched(posts, stored, "v1", F.col("text")).select("id", "title", "was_enriched")


@query("content_rules", "SELECT doc_id AS id, CASE WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}''])casino') THEN 'spam words' WHEN len(regexp_extract_all(text, '(?:https?://|www\\.)[^\\s<>\"]+|\\b(?:t\\.me|telegra\\.ph)/[^\\s<>\"]+')) > 2 THEN 'links' WHEN len(regexp_extract_all(text, '\\p{L}')) >= 20 AND len(regexp_extract_all(text, '\\p{Lu}')) > len(regexp_extract_all(text, '\\p{L}')) * 0.6 THEN 'capitals' WHEN len(regexp_extract_all(text, '\\p{So}')) > 10 THEN 'pictographs' WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}''])password') THEN 'scam words' ELSE 'ok' END AS verdict FROM documents")
def content_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first content rule that holds."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), extract.content_verdict(F.col("text"), ["casino"], ["password"], ["zzz"]).alias("verdict"))
