"""Posts with equal texts: each text is read once, and its posts differ by what they have of their own."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from tidemill.functions.contacts import LinkClass, LinkRules
from tidemill.operators import flow
from tidemill.session import shared_dir

RULES = flow.Rules({"job": ["wanted", "salary"], "closed": ["taken"]}, boilerplate=(("b", "part", "Join us"),))
POST = "id long, source string, text string, posted_at timestamp, fetched_at timestamp, is_backfill boolean, is_site boolean, international boolean, links array<struct<text:string,url:string>>, own array<string>"


def test_equal_texts_are_read_once(spark):
    text = "Cook wanted, salary 5 mln\nDeadline: 31.12\nJoin us @one_two\nCall +998 90 123 45 67"
    made = [(text, None, None), (text, [("apply", "https://forms.gle/x")], None), (text, None, ["@one_two"]), ("The job is taken", None, None), ("", None, None), (None, None, None), ("Deadline: 2023-05-01, cook wanted, salary", None, None)]
    rows = []
    for i in range(60):
        words, links, own = made[i % len(made)]
        rows.append((i, "ab"[i % 2] if i % 5 else None, words, dt.datetime(2022 + i % 4, 3, 1) if i % 3 else None, dt.datetime(2023, 3, 1), i % 11 == 0, [True, False, None][i % 3], i % 2 == 0, links, own))
    posts, now = spark.createDataFrame(rows, POST), F.lit("2024-06-01").cast("timestamp")
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/tidemill/texts-*"))
    once, each = (f(posts, RULES, now) for f in (flow.parsed_once, flow.parsed))
    assert once.columns == each.columns
    got, wanted = once.collect(), each.collect()
    assert sorted(map(repr, got)) == sorted(map(repr, wanted)) and len(got) == 60
    # by the year that a deadline leaves out
    assert {r["kind"] for r in got if r["text"].startswith("cook wanted, salary 5")} == {"job", "closed"}
    (folder,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/tidemill/texts-*")) - before
    assert spark.read.parquet(folder).count() == len({(r[1], r[2], str(r[8]), str(r[9])) for r in rows})


def test_links_are_read_beside_their_text(spark):
    """Copies that differ in their links: the text is read once, what links add is read for each post."""
    rules = flow.Rules({"job": ["wanted", "salary"], "closed": ["taken"], "ad": ["promo"]}, job_tags=["job"], boilerplate=(("b", "part", "Join us"),), links=LinkRules((LinkClass("form", r"forms\.example/", 3),), begin=("apply",)))
    texts = ["Cook (apply)\nNight driver apply\nJoin us @one_two", "Cook wanted, salary 5 mln\nmore at https://forms.example/z", "The job is taken\ncook apply", "#job cook\napply", "", None, " "]

    def link(words, url):
        return (words, url)

    rows = []
    for i in range(210):
        links = [None, [], [link("(apply)", f"https://a.example/{i}"), link("apply", f"https://b.example/{i}")], [link(None, f"https://t.me/someone{i % 7}"), link("apply", None)], [link("apply", f"https://promo.example/{i}")]][i % 5]
        rows.append((i, [None, "a", "b"][i % 3], texts[i % 7], dt.datetime(2022 + i % 4, 3, 1) if i % 3 else None, dt.datetime(2023, 3, 1), i % 11 == 0, [True, False, None][i % 4 % 3], i % 2 == 0, links, [None, ["@one_two"]][i % 11 % 2], [None, True, False][i % 13 % 3]))
    posts, now = spark.createDataFrame(rows, POST + ", needs_tag boolean"), F.lit("2024-06-01").cast("timestamp")
    columns = ("kind", "text", "own", "title", "company", "pay", "contacts", "place", "vote", "has_contact", "low_quality", "is_backfill", "international")
    for given in (posts, posts.drop("links"), posts.drop("own", "needs_tag", "is_site")):
        before = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/tidemill/texts-alone-*"))
        got = flow.parsed_by_text(given, rules, now, columns).collect()
        wanted = flow.parsed(given, rules, now).select("id", "posted_at", *columns).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, wanted)) and len(got) == 210
        (folder,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/tidemill/texts-alone-*")) - before
        assert spark.read.parquet(folder).count() == given.select("source", "text", *(c for c in ("own", "needs_tag") if c in given.columns)).distinct().count() <= 210
    assert {r["kind"] for r in flow.parsed_by_text(posts, rules, now, ("kind",)).collect()} >= {"job", "not_job", "closed", "no_text"}


def test_parsed_posts_read_each_text_once(spark, sf):
    from tidemill.plans import catalog

    found = catalog.queries()["parsed_posts"](spark, sf)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "texts-alone" in found.inputFiles()[0] + found.inputFiles()[-1] and "ArrowEvalPython" not in plan
