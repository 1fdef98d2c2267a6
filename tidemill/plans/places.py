"""Queries of places and of character references, over texts worded from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import places
from tidemill.plans.catalog import query
from tidemill.session import table
from tidemill.sources import feeds

REGIONS = ("africa", "america", "asia", "europe", "middle east")
#: Regions, and districts of which two are told by longer names that begin like a region's.
PLACES = places.Places(
    names=(
        *((r, r, None) for r in REGIONS), ("asia minor", "europe", "Asia Minor"), ("europe hall", "asia", "Europe Hall"), ("old port", "asia", "Old Port"), ("port", "africa", "Port"), ("hill", "america", "Hill"),
        ("desert", "middle east", "Desert"),
    ),
    streets=("street", "road"), remote=("remote", "from home"), on_site=("office",), areas=(("africa", "south"), ("asia", "south")),
)
_R = "CASE CAST(c_nationkey % 5 AS INT) WHEN 0 THEN 'africa' WHEN 1 THEN 'america' WHEN 2 THEN 'asia' WHEN 3 THEN 'europe' ELSE 'middle east' END"
_FORM = "CAST(c_custkey % 9 AS INT)"
_TEXT = f"""CASE {_FORM} WHEN 0 THEN 'Clerk in ' || upper({_R}) || ', mail asia@port.org, @europe_jobs, www.america.net' WHEN 1 THEN 'Europe street 5, Africa road' || chr(10) || 'in {{r}}n towns' WHEN 2 THEN 'Work at the Old Port. Old Port! Remote'
WHEN 3 THEN 'Asia Minor or ' || {_R} WHEN 4 THEN 'Africa, Asia, africa' || chr(10) || 'remote, two days in the office' WHEN 5 THEN 'Hill, hill and ' || {_R} || ', ' || {_R} || ', ' || {_R} || chr(10) || 'work from home' WHEN 6 THEN 'Eurasia and subafrica' WHEN 7 THEN 'Europe Hall, near the port' ELSE NULL END""".replace("{r}", f"' || {_R} || '")


@query("places_found", f"""WITH c AS (SELECT c_custkey AS id, {_R} AS r, {_FORM} AS f FROM customer)
SELECT id, CASE f WHEN 0 THEN r WHEN 1 THEN r WHEN 2 THEN 'asia' WHEN 3 THEN CASE WHEN r = 'europe' THEN 'europe' ELSE 'many' END WHEN 4 THEN 'africa' WHEN 5 THEN CASE WHEN r = 'america' THEN 'america' ELSE 'many' END WHEN 7 THEN 'asia' END AS region,
CASE f WHEN 2 THEN 'Old Port' WHEN 3 THEN CASE WHEN r = 'europe' THEN 'Asia Minor' END WHEN 5 THEN CASE WHEN r = 'america' THEN 'Hill' END WHEN 7 THEN 'Europe Hall' END AS district,
CAST(CASE f WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 5 WHEN 7 THEN 2 ELSE 0 END AS BIGINT) AS n, f IN (2, 5) AS remote FROM c""")
def places_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, district, mentions and remote work of all customers' texts: names inside others, streets, accounts, several areas, ties."""
    texts = spark.sql(f"SELECT c_custkey AS id, {_TEXT} AS text FROM {{customer}}", customer=table(spark, sf_dir, "customer"))
    found = texts.select("id", places.places_of(F.col("text"), PLACES).alias("p"))
    return found.select("id", "p.region", "p.district", "p.n", "p.remote")


@query("decoded_references", "SELECT page_id, CASE CAST(page_id % 6 AS INT) WHEN 0 THEN 'caf' || chr(233) || ' ' || page_id WHEN 1 THEN chr(8217) || 's ' || chr(8364) || page_id WHEN 2 THEN '• a < b & c' || chr(10) || '• ' || page_id WHEN 3 THEN chr(8212) || ' x' || chr(39) || page_id WHEN 4 THEN '&amp; stays ' || page_id ELSE 'AT&T ' || page_id END AS text FROM pages")
def decoded_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named, decimal and hexadecimal references, with and without a semicolon, each decoded once."""
    value = F.expr("CASE CAST(page_id % 6 AS INT) WHEN 0 THEN '<p>caf&eacute;&nbsp;' || page_id || '</p>' WHEN 1 THEN '&#8217;s &euro;' || page_id WHEN 2 THEN '<ul><li>a &lt b &amp; c</li><li class=x>' || page_id || '</li></ul>' WHEN 3 THEN '&mdash;&#x20;x&#x27;' || page_id WHEN 4 THEN '&amp;amp; stays <b>' || page_id || '</b>' ELSE 'AT&T <script>x &amp; y</script>' || page_id END")
    return table(spark, sf_dir, "pages").select("page_id", feeds.plain_html(value).alias("text"))
