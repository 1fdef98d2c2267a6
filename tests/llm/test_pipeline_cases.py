"""Each stage of the corpus pipeline: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F
from test_cases import DOCS, SCHEMA, clashing, docs

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
#: Labelled rows that language ID learns from, none of them a copy of another.
KNOWN = [(100 + k, f"the cat and the dog were here with us at number {k} of {7 * k} long days", "en", "a", 50) for k in range(60)] + [
    (300 + k, f"der hund und die katze waren nicht hier in der nummer {k} von {7 * k} langen tagen", "de", "b", 50) for k in range(60)
]


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, sf, name):
    out = STAGES[name](spark, docs(spark, []), sf)
    assert out.count() == 0
    assert name == "packing" or out.columns == corpus_pipeline.COLUMNS


@pytest.mark.parametrize("name", list(STAGES))
def test_clashing_columns_change_nothing(spark, sf, name):
    given = docs(spark, DOCS + KNOWN)
    plain, more = (STAGES[name](spark, d, sf) for d in (given, clashing(given).withColumn("lang_pred", F.lit("x")).withColumn("removed", F.lit(1))))
    assert plain.columns == more.columns
    if name == "packing":
        plain, more = (d.drop("sequence_id", "offset") for d in (plain, more))
    assert rows_of(plain) == rows_of(more)


def test_language_stage(spark, sf):
    out = STAGES["language ID"](spark, docs(spark, DOCS + KNOWN + [(7, "und die katze nicht", None, None, None)]), sf)
    got = [(r["doc_id"], r["lang"]) for r in out.collect()]
    ids = [d for d, _ in got]
    assert ids.count(1) == 2 and not {2, 3, 6} & set(ids) and None in ids  # repeated rows stay, null and letterless go
    assert {d for d, *_ in KNOWN} <= set(ids) and dict(got)[7] == "de" and dict(got)[1] == "en"
    assert STAGES["language ID"](spark, docs(spark, [(1, "nothing labelled", None, "a", 1)]), sf).count() == 0


def test_dedup_stage(spark, sf):
    rows = [*DOCS, (50, "Hello WORLD, this is a text", "en", "b", 27), (8, "b of two", "en", "a", 8), (8, "a of two", "en", "a", 8), (8, None, "en", "a", 8)]
    given = docs(spark, rows)
    out = [tuple(r) for r in STAGES["near dedup"](spark, given, sf).collect()]
    again = [tuple(r) for r in STAGES["near dedup"](spark, given.repartition(5), sf).collect()]
    assert sorted(map(str, out)) == sorted(map(str, again))
    ids = [r[0] for r in out]
    assert ids.count(1) == 1 and 50 not in ids and ids.count(8) == 1 and None in ids and {2, 3, 4, 5, 6} <= set(ids)


def test_mixing_stage(spark, sf):
    given = docs(spark, DOCS + KNOWN)
    out = [tuple(r) for r in STAGES["mixing"](spark, given, sf).collect()]
    assert set(out) <= {tuple(r) for r in given.collect()}
    assert out.count(DOCS[0]) % 2 == 0  # two equal rows are drawn alike


def test_packing_stage(spark, sf):
    got = STAGES["packing"](spark, docs(spark), sf).collect()
    assert {r["doc_id"] for r in got} == {d for d, *_ in DOCS}
    assert [(r["start"], r["length"]) for r in got if r["doc_id"] in (2, 3)] == [(0, 1)] * 2


def test_schema_is_that_of_documents():
    assert [c.split()[0] for c in SCHEMA.split(", ")] == corpus_pipeline.COLUMNS
