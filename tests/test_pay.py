"""Pay: each rule of the automaton on rows of its own, blocks of a text, and plans."""

import pytest
from pyspark.sql import functions as F

from tidemill.functions import pay as P


def read(*texts, label="", usual="UZS"):
    found = P.pay_of_blocks([(t, t, True) for t in texts], label, usual)
    return (found["lo"], found["hi"], found["currency"], found["period"])


@pytest.mark.parametrize(
    ("text", "lo", "hi", "currency", "period"),
    [
        ("6 200 000 so'm", 6_200_000, 6_200_000, "UZS", "month"),  # groups of three
        ("6.200.000", 6_200_000, 6_200_000, "UZS", "month"),
        ("6,2 mln", 6_200_000, 6_200_000, "UZS", "month"),  # a decimal
        ("900 ming so'm", 900_000, 900_000, "UZS", "month"),
        ("7 - 9 mln", 7_000_000, 9_000_000, "UZS", "month"),  # a scale for both
        ("7 — 9 500 000", 7_000_000, 9_500_000, "UZS", "month"),  # zeros left out
        ("8 million - 11 million", 8_000_000, 11_000_000, "UZS", "month"),
        ("12 000 000 mln", 12_000_000, 12_000_000, "UZS", "month"),  # a scale that cannot be meant
        ("from $700", 700, None, "USD", "month"),
        ("at least 900 usd", 900, None, "USD", "month"),
        ("$700+", 700, None, "USD", "month"),
        ("7 mlndan", 7_000_000, None, "UZS", "month"),
        ("7 mln so'm va undan yuqori", 7_000_000, None, "UZS", "month"),
        ("up to 1 200 usd", None, 1200, "USD", "month"),
        ("7 mln so'mgacha", None, 7_000_000, "UZS", "month"),
        ("700 € gacha", None, 700, "EUR", "month"),
        ("ot 6 mln do 9 mln", 6_000_000, 9_000_000, "UZS", "month"),
        ("6 mln, bonus", 6_000_000, None, "UZS", "month"),
        ("6 mln + 5%", 6_000_000, None, "UZS", "month"),
        ("70 ming kuniga", 70_000, 70_000, "UZS", "day"),
        ("40 usd/day", 40, 40, "USD", "day"),
        ("9 usd per hour", 9, 9, "USD", "hour"),
        ("haftalik 800 ming", 800_000, 800_000, "UZS", "week"),
        ("90 000 rub", 90_000, 90_000, "RUB", "month"),
        ("6 000 000 - 8 00 0000", 6_000_000, 8_000_000, "UZS", "month"),  # odd groups beside even ones
        ("6 00 000 - 8 000 000", 6_000_000, 8_000_000, "UZS", "month"),
        ("10:00-19:00, 20-30 yosh, 30%, 5/2, 3 smena, 2025-yil, 6 mln", 6_000_000, 6_000_000, "UZS", "month"),
        ("90 ming", None, None, None, None),  # not sane for a month
        ("9 mln soatiga", None, None, None, None),
        ("deposit 900 usd", None, None, None, None),
    ],
)
def test_rules(text, lo, hi, currency, period):
    assert read(text) == (lo, hi, currency, period)


def test_several_blocks_and_labels():
    assert read("erkaklar 5 000 000-9 00 0000", "ayollar 4 000 000") == (4_000_000, 9_000_000, "UZS", "month")
    assert read("60 ming", label="kunlik")[3] == "day"
    assert P.pay_of_blocks([("by agreement", "negotiable", True)])["negotiable"] is True
    assert P.pay_of_blocks([]) is None and P.pay_of_blocks([("", " ", True)]) is None


def test_blocks_of_a_text():
    def found(text):
        r = P.pay_of_text(text, text)
        return r and (r["lo"], r["hi"], r["currency"], r["text"])

    assert found("clerk\nmaosh:\n- kun 4 mln\n- tun 5 mln\n\n9 mln so'm") == (4_000_000, 5_000_000, "UZS", "- kun 4 mln | - tun 5 mln")
    assert found("salary: 4 mln.dan\n5 500 000 gacha\nage: 30") == (4_000_000, 5_500_000, "UZS", "4 mln.dan | 5 500 000 gacha")
    assert found("sotuvchi — 4-5 mln so'm") == (4_000_000, 5_000_000, "UZS", "4-5 mln so'm")  # no label: from the amount on
    assert found("maosh: 900 - 1 200\nhammasi usd") == (900, 1200, "USD", "900 - 1 200")
    assert found("salary is paid on time") is None and found("") is None
    assert found("maosh: 20") == (None, None, None, "20")


def test_columns_of_nulls_and_long_texts(spark):
    rows = [(1, None), (2, ""), (3, "Оклад: от 6 млн"), (4, "Maosh: 6️⃣ mln\n" + "x " * 200_000), (5, "Salary: 9 mln\nSalary: 8 mln")]
    got = {r["id"]: r["p"] for r in spark.createDataFrame(rows, "id long, text string").select("id", P.pay(F.col("text")).alias("p")).collect()}
    assert got[1] is None and got[2] is None
    assert (got[3]["lo"], got[3]["hi"], got[3]["currency"]) == (6_000_000, None, "UZS")
    assert got[4]["lo"] == 6_000_000 and (got[5]["lo"], got[5]["hi"]) == (8_000_000, 9_000_000)
    assert spark.createDataFrame([], "text string").select(P.pay(F.col("text"))).count() == 0


def test_nothing_beside_odd_digits_ends():
    # no power of ten brings 0 near to a number
    assert read("0 00 yoki 5 mln") == read("5 mln 0 00") == (None, None, None, None)
    assert read("0 yoki 5 00 0000") == (None, None, None, None)


def test_only_lines_that_may_hold_pay_are_read():
    def text(x):
        found = P.pay_of_text(x, x)
        return found and found["text"]

    assert text("a\n\nish  haqi:\n- 7\n\nx") == "- 7"
    assert text("first 3\nthen 4\nusd") is None  # a unit on the next line is not beside it
    assert text("8 mln\nx 10:00 k\n9 mlndan") == "8 mln | 9 mlndan"
    assert text("salary: 90\n$ 4") == "90 | $ 4"


@pytest.mark.parametrize("name", ["pay_ranges", "pay_report"])
def test_a_condition_on_pay_reads_no_text_twice(spark, sf, name):
    from tidemill.plans import catalog

    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # compatibility forms, and pay


def test_forms_of_plain_texts(spark):
    from tidemill.functions import text as T

    made = ["`A^b`", " a", "a ", "a  b", "a\t b\r", "a \n b", "a\n\n\n\nb", "\n\na", "a\x0bb\x0c", "^", "", "ok\n\nok", None]
    rows = [(i, t, None if t is None else t + "é") for i, t in enumerate(made)]
    got = spark.createDataFrame(rows, "id int, t string, f string").select("t", T.readable("t").alias("r"), T.fold("t").alias("l"), T.fold("f").alias("f")).collect()
    told = [r["r"] for r in got]
    assert told == ["'A b'", "a", "a", "a b", "a b", "a\nb", "a\n\nb", "a", "a b", "", "", "ok\n\nok", ""]
    assert [r["l"] for r in got] == [t.lower() for t in told]
    # as by the way that other texts take
    assert all(r["f"].removesuffix("é").strip() == r["l"] for r in got if r["t"] is not None)
