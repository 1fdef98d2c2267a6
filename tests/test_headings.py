"""Expressions of titles, links, boilerplate and rules are written once, not anew for each use."""

import random

from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import extract, headings
from tidemill.plans.headings import LINKS, RULES


def _size(df):
    return len(df._jdf.queryExecution().analyzed().expressions().mkString())


def test_values_used_twice_are_bound(spark):
    rows = spark.createDataFrame([("Driver wanted", None)], "text string, links array<struct<text:string,url:string>>")
    t = F.col("text")
    assert _size(rows.select(headings.title(t, RULES))) < 25_000
    assert _size(rows.select(headings.linked_lines(t, F.col("links"), LINKS))) < 25_000
    assert _size(rows.select(extract.stripped_text(t, F.lit("s"), (("s", "part", "Join"), ("s", "cut", "^Apply"), ("s", "line", "Our"))))) < 25_000


def test_content_rules_fold_a_text_once(spark):
    rows = spark.createDataFrame([("x",)], "text string")
    found = rows.select(extract.content_verdict(F.col("text"), ["casino"], ["password"], ["zzz"]).alias("v"))
    assert found._jdf.queryExecution().analyzed().expressions().mkString().count("\\p{So}\\p{Sk}") == 1


def test_letters_that_are_there_become_latin(spark):
    given = ["Ель ЕЛЬ объезд Объект", "ЩИ Щи щи ЮРА Цирк ОЦ оц", "Ўзбек ЎЗ ғоз ҒОЗ ЁЖ ёж", "plain text", "чай ЧАЙ Чай Ъ ь", None]
    want = ["Yel YEL ob'yezd Ob'yekt", "SHI Shi shi YURA Sirk OTS ots", "O'zbek O'Z g'oz G'OZ YOJ yoj", "plain text", "chay CHAY Chay ' ", None]
    rows = spark.createDataFrame(list(enumerate(given)), "id int, text string")
    found = rows.select("id", text.to_latin(F.col("text")).alias("a"), text.lower_latin(F.lower("text")).alias("b")).orderBy("id").collect()
    assert [r["a"] for r in found] == want and [r["b"] for r in found] == [w and w.lower() for w in want]


def test_field_of_a_text_equals_the_field_of_its_lines(spark):
    r = random.Random(5)
    parts = ["Duties:", "duties: cook, sell", "Salary: 5", "- a", "• b", "-", "", " ", "plain line", "Duties", "1st duties: x", "  duties :  y "]
    texts = [(k, "\n".join(r.choice(parts) for _ in range(r.randint(0, 14)))) for k in range(400)] + [(400, None), (401, "Duties:\n" + "- x\n" * 12)]
    rows = spark.createDataFrame(texts, "id int, text string")
    by_lines = {x["id"]: x["value"] for x in extract.labelled_field(extract.lines(rows), "duties").collect()}
    found = rows.select("id", extract.field_of(F.col("text"), "duties").alias("value"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {x["id"]: x["value"] for x in found.where("value is not null").collect()} == by_lines and len(by_lines) > 50
