"""The duplicate layers do no more work than they must: pairs out of reach are given up early, candidates are found without texts."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_streams import at, entries

from tidemill.functions import contacts, similarity
from tidemill.operators import dedup
from tidemill.session import stage


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def altered(rng, text, share):
    return "".join(rng.choice(["", rng.choice("abcé "), c + rng.choice("abcé ")]) if rng.random() < share else c for c in text)


def test_lengths_are_exact_where_they_reach_the_least(monkeypatch):
    rng = random.Random(31)
    a = ["".join(rng.choices("abcé ", k=rng.choice([0, 1, 40, 64, 65, 150]))) for _ in range(12)]
    b = [altered(rng, rng.choice(a), rng.choice([0, 0.05, 0.2, 0.9])) for _ in range(12)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(12), np.arange(12)))
    want = np.array([plain_lcs(a[x], b[y]) for x, y in zip(i.tolist(), j.tolist())])
    both = np.array([len(a[x]) + len(b[y]) for x, y in zip(i.tolist(), j.tolist())])
    for score in (0, 50, 85, 100):
        least = np.ceil(both * score / 200).astype(np.int64)
        got = dedup.lcs_lengths(a, b, i, j, least)
        assert (got[want >= least] == want[want >= least]).all() and (got[want < least] < least[want < least]).all()
        for x, y, n, wanted in zip(i.tolist(), j.tolist(), both.tolist(), want.tolist()):
            exact = 200.0 * wanted / n if n else 100.0
            assert similarity.ratio_of(a[x], b[y], score) == (exact if exact >= score else 0.0)
    # pairs without a common beginning are not followed to their ends
    looks, zeros = [], dedup._zeros
    monkeypatch.setattr(dedup, "_zeros", lambda v, n: looks.append(len(n)) or zeros(v, n))
    none = np.zeros(5, dtype=np.int64)
    assert dedup.lcs_lengths(["a" * 640 + "b" * 640], ["b" * 640 + "a" * 640], none, none, none + 1088).tolist() == [0] * 5
    assert len(looks) < 1280 / dedup.LOOK / 2


def test_candidates_are_found_without_texts(spark):
    e = stage(entries(spark, [(k, at(k), f"text of post {k} " * 4, f"post {k % 2}", ["@a"], "") for k in range(6)]).withColumn("n", F.length("text")), "entries")
    met = dedup._met(e.where("n > 0"), e.where("n > 39"), F.col("contacts"), 14, dedup._long_enough(F.col("a.n"), F.col("b.n"), dedup.STRICT))
    alike = dedup._alike_titles(e, e, 14)
    for found in (met, alike):
        assert "text:string" not in found._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 15 and alike.where("side = 2").count() == 4


def test_first_lines_and_addresses(spark):
    texts = ["1\n--\nab 2\n\n  a-b, cé !d\nsecond line", "Cook.\nPosition: Head cook\nend", "12 @ 3", "", None, "one\tline, #tag x@y.uz_b@c.uz www.a.uz/b t.me/abc", "a@b @c A@B.Uz\nAt"]
    posts = spark.createDataFrame([(k, t, at(k), at(k)) for k, t in enumerate(texts)], "id long, text string, posted_at timestamp, fetched_at timestamp").withColumn("text", F.lower("text"))
    got = [(r["title"], r["text"], r["contacts"]) for r in dedup.entries(posts, contacts.emails(F.col("text"))).orderBy("seq").collect()]
    assert got == [
        ("a b cé d", "1 ab 2 a b cé d second line", []),
        ("head cook", "cook position head cook end", []),
        ("", "12 3", []),
        ("", "", []),
        ("", None, []),
        ("one line tag x y uz_b c uz www a uz b t me abc", "one line x y uz_b c uz", ["x@y.uz", "_b@c.uz"]),
        ("a b c a b uz", "a b c a b uz at", ["a@b.uz"]),
    ]
