"""Ranks, matching and caps against plain loops, on tables where one key has half of the rows."""

import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemill.operators import alerts, queue, ranks, search
from tidemill.plans import catalog
from tidemill.plans.views import now, view
from tidemill.session import table
from tidemill.streaming import posts as steps

T0 = dt.datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_ranks_of_a_hot_group(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 3 == 0, None).otherwise((F.col("id") % 50).cast("string")).alias("g"), F.xxhash64("id").alias("x"), "id")
    got = ranks.ranked(rows, [F.col("x"), F.col("id")], ("g",))
    want = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: (r["x"], r["id"])):
        want[r["g"]].append(r["id"])
    assert {(r["g"], r["rank"]): r["id"] for r in got.collect()} == {(g, k): i for g, ids in want.items() for k, i in enumerate(ids)}
    every = ranks.ranked(rows, [F.desc("x"), F.col("id")])
    assert [r["id"] for r in every.orderBy("rank").collect()] == [r["id"] for r in sorted(rows.collect(), key=lambda r: (-r["x"], r["id"]))]
    assert ranks.ranked(rows.limit(0), [F.col("x")]).count() == 0


def loop_matches(jobs, subscriptions, banned, usd):
    import re

    def words(text):
        return re.findall(r"\w+", (text or "").lower())

    out = set()
    for s in subscriptions:
        if not s["is_active"] or s["user_id"] in banned:
            continue
        asked = [w for w in words(s["keyword"]) if len(w) >= 2][:6]
        for j in jobs:
            rate = usd if j["currency"] == "USD" else 1
            pays = [v * rate for v in (j["salary_min"], j["salary_max"]) if v is not None]
            good = s["category"] in (None, j["category"]) and s["profession"] in (None, j["profession"])
            good = good and (s["region"] is None or (j["is_remote"] if s["region"] == "remote" else j["region"] == s["region"]))
            if s["min_salary"] is not None:
                good = good and j["currency"] in ("UZS", "USD") and j["salary_period"] in (None, "month") and any(p >= s["min_salary"] for p in pays)
            if s["keyword"] is not None:
                good = good and bool(asked) and all(any(t.startswith(w) for t in words(j["search_text"])) for w in asked)
            if good:
                out.add((j["id"], s["id"]))
    return out


@pytest.mark.parametrize("most", [None, 0])
def test_matching_equals_a_loop(spark, sf, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(alerts, "BROADCAST_SUBSCRIPTIONS", most)
        monkeypatch.setattr(alerts, "HOT_JOBS", 50)
    jobs = view(spark, sf, "jobs")
    schema = "id long, user_id long, category string, profession string, region string, min_salary long, keyword string, is_active boolean"
    asked = [
        (1, 1, "low", None, None, None, None, True), (2, 1, None, "role3", "asia", None, None, True), (3, 2, None, None, "remote", None, None, True), (4, 2, None, None, None, 250000, None, True),
        (5, 3, None, None, None, None, "nation_1 ro", True), (6, 3, "urgent", None, "remote", 100, "ur", True), (7, 4, None, None, None, None, None, True), (8, 4, None, None, None, None, "!", True),
        (9, 5, None, None, None, 0, None, True), (10, 6, "low", None, None, None, None, True), (11, 1, "low", None, None, None, None, False), (12, 1, None, "role1", None, None, "role1 role1 asia", True),
    ]
    subscriptions = spark.createDataFrame(asked, schema)
    users = spark.createDataFrame([(k, k == 6) for k in range(1, 7)], "id long, is_banned boolean")
    found = alerts.matches(jobs, subscriptions, users, now(), 12500.0)
    assert "Cartesian" not in plan(found) and "NestedLoop" not in plan(found)
    rows = jobs.where(search.is_open(now())).collect()
    got = [(r["id"], r["subscription_id"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == loop_matches(rows, [dict(zip([c.split()[0] for c in schema.split(", ")], a)) for a in asked], {6}, 12500.0)


@pytest.mark.parametrize("most", [None, 0])
def test_matching_by_classes_equals_the_pairs(spark, sf, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(alerts, "MOST_ASKED", most)
    jobs = view(spark, sf, "jobs")
    schema = "id long, user_id long, category string, profession string, region string, min_salary long, keyword string, is_active boolean"
    asked = [
        (1, 1, "low", None, None, None, None, True), (2, 1, "low", None, None, None, None, True), (3, 2, None, None, "remote", None, None, True), (4, 2, None, None, None, 250000, None, True), (5, 3, None, None, None, 1000000, "nation_1 ro", True),
        (6, 3, "urgent", None, "remote", 100, "ur", True), (7, 4, None, None, None, None, None, True), (8, 4, None, "role3", "asia", None, "!", True), (9, 5, "low", None, None, None, None, True), (10, 5, "low", None, None, None, None, True), (11, 6, "low", None, None, None, None, True),
    ]
    for rows in (asked, asked[:2]):
        subscriptions = spark.createDataFrame(rows, schema)
        users = spark.createDataFrame([(k, k == 6) for k in range(1, 7)], "id long, is_banned boolean")
        pairs = [(r["id"], r["subscription_id"], r["user_id"]) for r in alerts.matches(jobs, subscriptions, users, now(), 12500.0).collect()]
        found = alerts.matched(jobs, subscriptions, users, now(), 12500.0)
        want = {s: (sum(p[1] == s for p in pairs), min(p[0] for p in pairs if p[1] == s)) for s in {p[1] for p in pairs}}
        assert {r["subscription_id"]: (r["n"], r["first_job"]) for r in found.of_subscriptions().collect()} == want
        want = {u: (len({p[0] for p in pairs if p[2] == u}), sum(p[2] == u for p in pairs)) for u in {p[2] for p in pairs}}
        assert {r["user_id"]: (r["messages"], r["hits"]) for r in found.of_users().collect()} == want
    if most is None:
        # one row for what filters tell apart, not one for each match
        def n(times):
            every = jobs.crossJoin(spark.range(times).withColumnRenamed("id", "k")).withColumn("id", F.col("id") * 10 + F.col("k"))
            return alerts.matched(every, spark.createDataFrame(asked, schema), users, now(), 12500.0).pairs.count()

        assert n(1) == n(3)


def test_slots_equal_a_loop(spark, sf):
    start, step = dt.datetime(1998, 6, 1, 12), 300
    waiting = view(spark, sf, "jobs").where(F.col("status").isin(*queue.SENDABLE)).orderBy(*queue.publish_order()).select("id").collect()
    got = {r["id"]: r["publish_at"] for r in queue.slot_times(view(spark, sf, "jobs"), str(start), step, 23, 7).collect()}
    at = start
    for r in waiting:
        while at.hour >= 23 or at.hour < 7:
            at = (at + dt.timedelta(days=at.hour >= 23)).replace(hour=7, minute=0, second=0)
        assert got[r["id"]] == at
        at += dt.timedelta(seconds=step)
    assert len(got) == len(waiting)


def test_lifecycle_of_all_events_equals_a_loop(spark, sf):
    names = ("claim", "sent", "error", "retry", "close", "release", "stuck")
    got = {r["id"]: (r["status"], r["attempts"], r["ignored"]) for r in catalog.queries()["lifecycle"](spark, sf).collect()}
    state = defaultdict(lambda: ["queued", 0, 0])
    for r in sorted(table(spark, sf, "events").collect(), key=lambda r: (r["ts"], r["event_id"])):
        s, e = state[r["user_id"]], names[r["event_id"] % 7]
        to = steps.MOVES.get((s[0], e))
        if to is None:
            s[2] += 1
        else:
            s[1] = s[1] + 1 if e == "error" else 0 if e == "retry" else s[1]
            s[0] = "failed" if e == "error" and s[1] >= 8 else to
    assert got == {k: tuple(v) for k, v in state.items()}


def test_greedy_parts_of_all_documents_equal_a_loop(spark, sf):
    got = {(r["owner"], r["id"]): r["part"] for r in catalog.queries()["digest_parts"](spark, sf).collect()}
    held = defaultdict(lambda: [0, 0])
    for r in sorted(table(spark, sf, "documents").collect(), key=lambda r: (r["source"] or "", r["doc_id"])):
        s, n = held[r["source"]], len(r["text"] or "")
        if s[1] and s[1] + n > 4000:
            s[0], s[1] = s[0] + 1, 0
        s[1] += n
        assert got[r["source"], r["doc_id"]] == s[0]


def test_throttled_notices_equal_a_loop(spark, sf):
    got = {r["id"]: r["sent"] for r in catalog.queries()["throttled_notices"](spark, sf).collect()}
    last = {}
    for r in sorted(table(spark, sf, "events").collect(), key=lambda r: (int(r["ts"].timestamp()), r["event_id"])):
        s = int(r["ts"].timestamp())
        sent = r["user_id"] not in last or s - last[r["user_id"]] >= 3600
        assert got[r["event_id"]] == sent
        if sent:
            last[r["user_id"]] = s
    assert sum(got.values()) > 100


@pytest.mark.parametrize("name", ["slot_plan", "spacing", "rate_as_of_all", "rotating_assets_all", "subscription_matches", "user_messages", "daily_cap"])
def test_no_single_partition_and_no_pairs_of_all(spark, sf, name):
    text = plan(catalog.queries()[name](spark, sf))
    assert "SinglePartition" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
