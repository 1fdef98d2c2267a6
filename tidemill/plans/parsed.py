"""The per-post part of the flow with all its rules, over posts worded from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.contacts import LinkClass, LinkRules
from tidemill.operators import flow, headings
from tidemill.plans.catalog import query
from tidemill.plans.places import PLACES
from tidemill.session import spread, table

RULES = flow.Rules(
    {"job": ["wanted", "salary", "schedule"], "closed": ["taken"], "ad": ["channel"]},
    links=LinkRules((LinkClass("form", r"forms\\.example/", 3),), begin=("apply",)),
    boilerplate=(("s1", "part", "Join our channel"), ("s1", "cut", "^Apply only"), ("s2", "line", "Our motto: .*")),
    places=PLACES, categories=(("driver", "driver", "roads"), ("truck", "driver", "roads"), ("cook", "cook", "food"), ("kitchen", "cook", "food"), ("waiter", "waiter", "food")),
    headings=headings.Rules(professions=("driver", "cook", "waiter")),
    profile_labels=("name", "age", "skills", "city"), seeker=("looking for work",), employer=("we offer",),
)
_FORM = "CAST(o_orderkey % 9 AS INT)"
_R = "CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'Europe' WHEN 1 THEN 'Asia' ELSE 'Middle East' END"
_TEXT = f"""CASE {_FORM} WHEN 0 THEN '***' || chr(10) || 'Driver wanted' || chr(10) || 'Salary: 5 mln, in ' || {_R} || chr(10) || 'Join our channel @jobs_daily' || chr(10) || '@boss_one' || chr(10) || '#work #driver'
WHEN 1 THEN 'Cook wanted for a truck stop' || chr(10) || 'Schedule: 5/2' || chr(10) || {_R} || chr(10) || 'Join our channel @jobs_daily'
WHEN 2 THEN 'Name: Olim' || chr(10) || 'Age: 30' || chr(10) || 'Skills: cook, driver' || chr(10) || 'Looking for work in ' || {_R} || ', salary 5 mln'
WHEN 3 THEN 'Two jobs' || chr(10) || 'Net admin (apply)' || chr(10) || 'Java person apply' || chr(10) || {_R}
WHEN 4 THEN 'We want a waiter in our kitchen, wanted' || chr(10) || 'Salary: 3 mln' || chr(10) || {_R} || ', {{r}}' || chr(10) || 'Apply only by mail' || chr(10) || 'to x@y.example' || chr(10) || 'Seen in Africa'
WHEN 5 THEN 'Our motto: never rest, wanted, salary' || chr(10) || 'Words about ' || {_R}
WHEN 6 THEN 'The driver job is taken' || chr(10) || {_R} || ' salary' WHEN 7 THEN 'Our channel about nothing' || chr(10) || 'wanted' ELSE NULL END""".replace("{r}", f"' || {_R} || '")


def worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as posts of two sources, with hidden links."""
    rows = spark.sql(f"SELECT o_orderkey AS id, CASE WHEN {_FORM} = 5 THEN 's2' ELSE 's1' END AS source, {_TEXT} AS text, {_FORM} AS form, CAST(o_orderdate AS TIMESTAMP) AS posted_at FROM {{orders}}", orders=spread(table(spark, sf_dir, "orders")))

    def link(words: str, url: str) -> F.Column:
        return F.struct(F.lit(words).alias("text"), F.concat(F.lit(url), F.col("id").cast("string")).alias("url"))

    two = F.array(link("(apply)", "https://a.example/"), link("apply", "https://b.example/"))
    return rows.withColumn("links", F.when(F.col("form") == 3, two)).withColumn("fetched_at", F.col("posted_at"))


@query("parsed_posts", f"""WITH o AS (SELECT o_orderkey AS id, {_FORM} AS f, lower({_R}) AS r FROM orders) SELECT id,
CASE f WHEN 0 THEN 'job' WHEN 1 THEN 'job' WHEN 2 THEN 'resume' WHEN 3 THEN 'job' WHEN 4 THEN 'job' WHEN 5 THEN 'not_job' WHEN 6 THEN 'closed' WHEN 7 THEN 'not_job' ELSE 'no_text' END AS kind,
CASE WHEN f <= 6 THEN r END AS region, CASE f WHEN 0 THEN 'roads' WHEN 1 THEN 'food' WHEN 2 THEN 'food' WHEN 4 THEN 'food' WHEN 6 THEN 'roads' ELSE 'other' END AS category,
CASE f WHEN 0 THEN 'driver' WHEN 1 THEN 'cook' WHEN 2 THEN 'cook' WHEN 4 THEN 'waiter' WHEN 6 THEN 'driver' END AS profession,
CASE f WHEN 0 THEN 'Driver' WHEN 1 THEN 'Cook' WHEN 6 THEN 'Driver job is taken' END AS title, f IN (0, 1, 3, 4) AS has_contact FROM o""")
def parsed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, region, category and title of all orders' posts, boilerplate out first, each text read once."""
    found = flow.parsed_by_text(worded(spark, sf_dir), RULES, F.lit("1990-01-01").cast("timestamp"), ("kind", "place", "vote", "title", "has_contact"))
    return found.select("id", "kind", "place.region", "vote.category", "vote.profession", "title", "has_contact")
