"""Admin alerts: batch and stream against a loop over the same hits."""

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidemill.streaming import admin_alerts

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "owner long, post_id long, subscription_id long, subscribed_at timestamp, fetched_at timestamp"


def hits(n=500):
    rng, rows, at = random.Random(41), [], 0
    for post in range(n):
        at += rng.choice([5, 20, 60, 400, 900])
        for sub in range(rng.randint(0, 3)):
            owner = rng.choice([1, 1, 1, 2, 3])
            rows.append((owner, post, sub, T0 + dt.timedelta(hours=2) if owner == 3 else T0, T0 + dt.timedelta(seconds=at)))
    return rows


def loop(rows, cap, minutes):
    seen, sent, waiting, out = set(), defaultdict(list), {}, []
    for owner, post, _, since, at in sorted(rows, key=lambda r: (r[4], r[1], r[0], r[2])):
        if at < since or (owner, post) in seen:
            continue
        seen.add((owner, post))
        if owner in waiting and at > waiting[owner][0]:
            out.append((owner, "list", ",".join(map(str, waiting[owner][1])), waiting.pop(owner)[0]))
        if sum(s >= at - dt.timedelta(hours=1) for s in sent[owner]) < cap:
            sent[owner].append(at)
            out.append((owner, "sent", str(post), at))
        else:
            waiting.setdefault(owner, (at + dt.timedelta(minutes=minutes), []))[1].append(post)
    return sorted(out + [(o, "list", ",".join(map(str, posts)), due) for o, (due, posts) in waiting.items()])


def test_batch_equals_a_loop(spark):
    rows = hits()
    got = sorted((r["owner"], r["kind"], r["posts"], r["at"]) for r in admin_alerts.told(spark.createDataFrame(rows, SCHEMA), 4).collect())
    want = loop(rows, 4, 60)
    assert got == want and sum(k == "list" for _, k, _, _ in want) > 5
    odd = spark.createDataFrame([(None, 1, 1, None, T0), (1, None, 1, None, T0), (1, 1, 1, None, None), (1, 2, None, None, T0)], SCHEMA)
    assert [(r["owner"], r["kind"], r["posts"]) for r in admin_alerts.told(odd, 4).collect()] == [(1, "sent", "2")]
    assert admin_alerts.told(odd.limit(0), 4).count() == 0


def test_stream_equals_a_loop(spark, tmp_path):
    rows, source, mark, out = hits(200), f"{tmp_path}/hits", f"{tmp_path}/mark", f"{tmp_path}/out"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", admin_alerts.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        last = max(r[4] for r in rows) + dt.timedelta(days=60)
        parts = [rows[k : k + 150] for k in range(0, len(rows), 150)] + [rows[:5], [(9, 10**6, 0, T0, last)], [(9, 10**6 + 1, 0, T0, last + dt.timedelta(seconds=1))]]
        for part in parts:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = admin_alerts.follow(spark.readStream.schema(SCHEMA).parquet(source), 4)
            stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
        got = sorted((r["owner"], r["kind"], r["posts"], r["at"]) for r in spark.read.parquet(out).where("owner <> 9").collect())
        assert got == loop(rows, 4, 60)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_query_over_all_posts_equals_a_loop(spark, sf):
    from tidemill.plans import catalog, stored

    rows = [tuple(r) for r in stored.admin_hits(spark, sf).select(*(c.split()[0] for c in SCHEMA.split(", "))).collect()]
    got = sorted((r["owner"], r["kind"], r["posts"], r["at"]) for r in catalog.queries()["admin_alerts"](spark, sf).collect())
    assert got == loop(rows, 1, 180) and len(got) > 50
