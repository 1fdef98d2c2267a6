"""Queries of pay: ads worded from the numbers that must come out of them, in every form that the automaton knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.pay import pay_once
from tidemill.plans.catalog import query
from tidemill.session import spread, table

# two small numbers of every order, u < v, as text and as numbers; each form of wording with its lower and upper end, currency and period
_U, _V = "(1 + CAST(floor(o_totalprice) AS BIGINT) % 9)", "(2 + CAST(floor(o_totalprice) AS BIGINT) % 9 + o_custkey % 7)"
FORMS = [
    ("'Maosh: {u} - {v} mln so{q}m'", "{u} * 1000000", "{v} * 1000000", "UZS", "month"),
    ("'Ish haqi — {u} 000 000 - {v} 000 000'", "{u} * 1000000", "{v} * 1000000", "UZS", "month"),
    ("'Kunlik: {u} ming'", "NULL", "NULL", None, None),
    ("'Kunlik: {v}0 ming, tushlik bilan'", "CASE WHEN {v} >= 3 THEN {v} * 10000 END", "CASE WHEN {v} >= 3 THEN {v} * 10000 END", "UZS", "day"),
    ("'Boshlanishiga haftasiga {u}00 000 dan {v}00 000 so{q}mgacha'", "{u} * 100000", "{v} * 100000", "UZS", "week"),
    ("'Pay: ${u}00 per week'", "{u} * 100", "{u} * 100", "USD", "week"),
    ("'Зарплата: от {u} 000 000 до {v} 000 000 сум'", "{u} * 1000000", "{v} * 1000000", "UZS", "month"),
    ("'Maosh: {u} – {v} 000 000 so{q}m'", "{u} * 1000000", "{v} * 1000000", "UZS", "month"),
    ("'Maosh:' || chr(10) || '- kunduz {u} 000 000' || chr(10) || '- kechasi {v} 000 000 gacha' || chr(10) || chr(10) || 'Tel 99 000 000'", "{u} * 1000000", "{v} * 1000000", "UZS", "month"),
    ("'Salary: 09:00-18:00, 18-35 yosh, 50% chegirma, 6/1, {u} 000 000 + KPI'", "{u} * 1000000", "NULL", "UZS", "month"),
    ("'We pay from {u}0 usd per hour'", "{u} * 10", "NULL", "USD", "hour"),
    ("'Oylik: {u} mln.dan' || chr(10) || '{v} 500 000 gacha'", "{u} * 1000000", "{v} * 1000000 + 500000", "UZS", "month"),
    ("'Maosh: 250 000'", "NULL", "NULL", None, None),
    ("'Depozit {u}00$ kerak'", "NULL", "NULL", None, None),
    ("'Maosh: {u}00 - {v}00' || chr(10) || 'Hammasi dollarda, USD'", "{u} * 100", "{v} * 100", "USD", "month"),
    ("'Maosh: kelishiladi'", "NULL", "NULL", None, None),
    ("'Maosh: {v} 000 000 - {v}0 00 0000'", "{v} * 1000000", "{v} * 1000000", "UZS", "month"),
    ("'Up to {v}00 € monthly for the right person'", "NULL", "{v} * 100", "EUR", "month"),
]
_FORM = f"CAST((o_orderkey + o_custkey) % {len(FORMS)} AS INT)"


def _worded(form: str) -> str:
    return form.replace("{u}", f"' || CAST({_U} AS VARCHAR(9)) || '").replace("{v}", f"' || CAST({_V} AS VARCHAR(9)) || '").replace("{q}", "' || chr(39) || '")


def _case(values: list[str]) -> str:
    return f"CASE {_FORM} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def _number(form: str) -> str:
    return form.replace("{u}", _U).replace("{v}", _V)


def _name(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


_TEXT = _case([_worded(f[0]) for f in FORMS])
_SQL = f"""WITH told AS (SELECT o_orderkey AS id, {_case([_number(f[1]) for f in FORMS])} AS lo, {_case([_number(f[2]) for f in FORMS])} AS hi, {_case([_name(f[3]) for f in FORMS])} AS currency,
{_case([_name(f[4]) for f in FORMS])} AS period, {_FORM} = 15 AS negotiable FROM orders)
SELECT id, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, CASE WHEN coalesce(lo, hi) IS NOT NULL THEN currency END AS currency, CASE WHEN coalesce(lo, hi) IS NOT NULL THEN period END AS period, negotiable FROM told"""


@query("pay_forms", _SQL)
def pay_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay of all orders' ads: multipliers, grouped and odd digits, shared scales, bounds, several lines, noise, all periods, no pay."""
    ads = spark.sql(f"SELECT o_orderkey AS id, 'Clerk wanted' || chr(10) || {_TEXT} || chr(10) || 'Call us' AS text FROM {{orders}}", orders=spread(table(spark, sf_dir, "orders")))
    found = ads.select("id", pay_once(F.col("text")).alias("p"))
    return found.select("id", "p.lo", "p.hi", "p.currency", "p.period", F.coalesce("p.negotiable", F.lit(False)).alias("negotiable"))


@query("pay_report", f"""WITH told AS (SELECT {_case([_number(f[1]) for f in FORMS])} AS lo, {_case([_number(f[2]) for f in FORMS])} AS hi, {_case([_name(f[3]) for f in FORMS])} AS currency, {_case([_name(f[4]) for f in FORMS])} AS period FROM orders)
SELECT currency, period, count(*) AS n, CAST(min(coalesce(lo, hi)) AS BIGINT) AS least, CAST(quantile_disc(coalesce(lo, hi), 0.5) AS BIGINT) AS middle, CAST(max(coalesce(hi, lo)) AS BIGINT) AS most FROM told WHERE coalesce(lo, hi) IS NOT NULL GROUP BY ALL""")
def pay_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: how much is paid, by currency and period: number of ads, least, middle and greatest pay."""
    low, high = F.coalesce("lo", "hi"), F.coalesce("hi", "lo")
    known = pay_forms(spark, sf_dir).where(low.isNotNull())
    return known.groupBy("currency", "period").agg(F.count(F.lit(1)).alias("n"), F.min(low).alias("least"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY coalesce(lo, hi))").alias("middle"), F.max(high).alias("most"))
