"""Queries of titles, employers and lists of positions: ads worded from orders in the form of each detector, also with signs of others beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.contacts import LinkClass, LinkRules
from tidemill.operators import headings
from tidemill.plans.catalog import query
from tidemill.session import spread, table

_CLERK = "CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'driver' WHEN 1 THEN 'night cook' ELSE 'seller' END"
RULES = headings.Rules(professions=("driver", "cook", "seller", "sales"))
LINKS = LinkRules((LinkClass("form", r"forms\.example/", 3), LinkClass("news", r"news\.example/", 0)), begin=("apply",))
_BIG = f"upper(substring({_CLERK}, 1, 1)) || substring({_CLERK}, 2)"
_FORM = "CAST(o_orderkey % 10 AS INT)"
_TITLE_TEXT = f"""CASE {_FORM} WHEN 0 THEN 'Great news!' || chr(10) || '• Position: ' || {_CLERK} || ' people' || chr(10) || 'Cook wanted' WHEN 1 THEN 'Hello' || chr(10) || 'We are looking for a ' || {_CLERK} || ', who can start now' WHEN 2 THEN upper({_CLERK}) || ' WANTED!' WHEN 3 THEN 'Open position' || chr(10) || '- ' || {_CLERK} || '.' || chr(10) || 'Salary: 5 mln'
WHEN 4 THEN {_CLERK} || chr(10) || 'Salary: cook wanted' WHEN 5 THEN 'Vacancy: Manager of ' || {_CLERK} || ' services' WHEN 6 THEN 'Vacancy - ' || {_CLERK} || ' Manager' WHEN 7 THEN 'Duties: a ' || {_CLERK} || ' is wanted' || chr(10) || 'Nice people wanted' WHEN 8 THEN 'Seven long words about our driver in town today' ELSE NULL END"""


@query("ranked_titles", f"""WITH o AS (SELECT o_orderkey AS id, {_BIG} AS t, {_CLERK} AS c, {_FORM} AS f FROM orders) SELECT id, CASE WHEN f IN (0, 1, 2, 3, 4) THEN t WHEN f = 5 THEN t || ' services manager' WHEN f = 6 THEN t || ' manager' END AS title,
CASE WHEN f IN (0, 5, 6) THEN 'label' WHEN f IN (1, 2) THEN 'phrase' WHEN f = 3 THEN 'announced' WHEN f = 4 THEN 'first line' END AS source FROM o""")
def ranked_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: titles of all orders' ads by label, phrase, announced line and first line, with their ends, order and case repaired; none from fields."""
    texts = spark.sql(f"SELECT o_orderkey AS id, {_TITLE_TEXT} AS text FROM {{orders}}", orders=spread(table(spark, sf_dir, "orders")))
    found = texts.select("id", headings.title(F.col("text"), RULES).alias("t"))
    return found.select("id", "t.title", "t.source")


_NAME = "'Firm ' || CAST(c_nationkey AS VARCHAR(9))"
_COMPANY_TEXT = f"""CASE CAST(c_custkey % 9 AS INT) WHEN 0 THEN 'Company: «' || {_NAME} || '» — makers of things' || chr(10) || 'employer: ' || upper({_NAME}) WHEN 1 THEN 'Company: ' || {_NAME} || chr(10) || 'Employer: Another One' WHEN 2 THEN 'Company: modern and friendly office' || chr(10) || {_NAME} || ' is looking for a cook' WHEN 3 THEN 'Work at LLC «' || {_NAME} || '» today'
WHEN 4 THEN 'Work at "' || {_NAME} || '" Ltd today' WHEN 5 THEN 'All about ' || {_NAME} || ' LLC.' WHEN 6 THEN 'Come and join the ' || {_NAME} || ' now' WHEN 7 THEN 'Employer: one. two three' || chr(10) || 'company: small firm' ELSE NULL END"""


@query("ranked_employers", f"""SELECT c_custkey AS id, CASE WHEN CAST(c_custkey % 9 AS INT) IN (0, 2, 3, 4, 5, 6) THEN {_NAME} END AS company FROM customer""")
def ranked_employers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employers of all customers' ads by labels that agree, by who looks, beside forms of firms, by teams; slogans and sentences are none."""
    texts = spark.sql(f"SELECT c_custkey AS id, {_COMPANY_TEXT} AS text FROM {{customer}}", customer=table(spark, sf_dir, "customer"))
    return texts.select("id", headings.employer(F.col("text"), RULES).alias("company"))


_KIND = "CAST((page_id + length(url)) % 7 AS INT)"
_PAGE_TEXT = f"""CASE {_KIND} WHEN 0 THEN 'Hello' || chr(10) || 'Our open positions:' || chr(10) || '• Driver' || chr(10) || chr(10) || '- driver' || chr(10) || '2) Night cook' || chr(10) || 'Salary: 5 mln' || chr(10) || 'Seller' WHEN 1 THEN '1. Net admin (apply)' || chr(10) || 'see our news' || chr(10) || 'Java person - https://forms.example/' || page_id || chr(10) || 'Head of sales apply'
WHEN 2 THEN '1. Driver' || chr(10) || '2. Calm place' || chr(10) || '3) night cook' || chr(10) || '4. FOREMAN' WHEN 3 THEN 'Driver wanted' || chr(10) || 'Place: east' || chr(10) || chr(10) || 'We hire a cook' || chr(10) || 'Salary: 3 mln' WHEN 4 THEN 'Driver wanted' || chr(10) || 'Place: east' || chr(10) || chr(10) || 'Cook wanted' || chr(10) || 'call us' WHEN 5 THEN 'apply' || chr(10) || 'two words apply' || chr(10) || 'two words apply' ELSE NULL END"""


def _worded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.sql(f"SELECT page_id, {_KIND} AS kind, {_PAGE_TEXT} AS text FROM {{pages}}", pages=table(spark, sf_dir, "pages"))
    k = F.col("page_id").cast("string")

    def link(words: str, address: str) -> F.Column:
        return F.struct(F.lit(words).alias("text"), F.concat(F.lit(address), k).alias("url"))

    none = F.array().cast(headings.LINKS)
    every = F.when(F.col("kind") == 1, F.array(link("(apply)", "https://a.example/"), link(" ", "https://b.example/"), link("news", "https://news.example/"), link("apply", "https://c.example/")))
    again = F.when(F.col("kind") == 5, F.array(link("apply", "https://a.example/"), link("apply", "https://b.example/"), link("apply", "https://c.example/")))
    return texts.withColumn("links", F.coalesce(every, again, none))


@query("linked_positions", f"""WITH p AS (SELECT page_id, {_KIND} AS kind FROM pages), l AS (SELECT page_id, unnest(CASE kind WHEN 1 THEN ['Net admin|https://a.example/', 'Java person|https://forms.example/', 'Head of sales|https://c.example/'] WHEN 5 THEN ['two words|https://b.example/', 'two words|https://c.example/'] ELSE [] END) AS x FROM p)
SELECT page_id, split_part(x, '|', 1) AS position, split_part(x, '|', 2) || page_id AS url FROM l""")
def linked_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all pages' lists with links of their own, lines and links used up in order; words that repeat; links without words; bare addresses."""
    found = _worded_pages(spark, sf_dir).select("page_id", F.explode(headings.linked_lines(F.col("text"), F.col("links"), LINKS)).alias("x"))
    return found.select("page_id", "x.position", "x.url")


@query("position_lists", f"""SELECT page_id, CASE {_KIND} WHEN 0 THEN 'Driver|Night cook' WHEN 1 THEN 'Net admin|Java person|Head of sales' WHEN 2 THEN 'Driver|night cook|FOREMAN' WHEN 3 THEN 'Driver|Cook' ELSE '' END AS positions FROM pages""")
def position_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of all pages' lists by heading, links, numbers and whole blocks, the first sign that gives two."""
    found = _worded_pages(spark, sf_dir).select("page_id", headings.positions(F.col("text"), F.col("links"), RULES, LINKS).alias("p"))
    return found.select("page_id", F.array_join("p", "|").alias("positions"))
