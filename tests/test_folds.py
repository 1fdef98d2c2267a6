"""Folds over keys with most of the rows: equal to loops, and no task reads much more than its share."""

import datetime as dt
import glob
import random
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemill.operators import alerts, folds
from tidemill.session import shared_dir
from tidemill.streaming import posts as steps


def hot(spark, n=4000):
    """Half of the rows have one key, some none; several rows a second."""
    rng = random.Random(21)
    rows = [(k, "hot" if k % 2 else rng.choice(["a", "b", None, *(f"k{j}" for j in range(40))]), rng.randrange(0, 40_000), rng.choice([0, 1, 7, 30, 90, 400])) for k in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, owner string, s long, length int").withColumn("ts", F.timestamp_seconds("s")), rows


def test_parts_jump_as_a_loop_goes():
    rng = random.Random(22)
    for _ in range(400):
        lengths = [rng.choice([0, 0, 1, 2, 5, 9, 30]) for _ in range(rng.randint(1, 40))]
        fold = alerts.Parts(rng.choice([3, 9, 20, 100]), "n")
        cut = sorted(rng.sample(range(len(lengths) + 1), min(3, len(lengths))))
        state = fold.start
        for lo, hi in zip([0, *cut], [*cut, len(lengths)]):
            rows = pd.DataFrame({"n": np.array(lengths[lo:hi], dtype=np.int64)})
            if len(rows):
                part, held = state
                for n in lengths[lo:hi]:
                    if held and held + n > fold.most:
                        part, held = part + 1, 0
                    held += n
                state = fold.after(fold.function(rows), state)
                assert state == (part, held)


def test_parts_of_a_hot_owner(spark):
    df, rows = hot(spark)
    got = {r["id"]: r["part"] for r in alerts.parts(df.select("owner", "id", "length"), 400).collect()}
    held = defaultdict(lambda: [0, 0])
    for k, owner, _, n in sorted(rows):
        s = held[owner]
        if s[1] and s[1] + n > 400:
            s[0], s[1] = s[0] + 1, 0
        s[1] += n
        assert got[k] == s[0]
    assert len(got) == len(rows)


def test_a_hot_key_lies_in_many_chunks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df, rows = hot(spark, 6400)
        chunks = folds.chunked(df, "owner", ["s", "id"])
        sizes = [r["count"] for r in chunks.groupBy("_chunk").count().collect()]
        assert max(sizes) <= 0.04 * len(rows) and chunks.where("owner = 'hot'").select("_chunk").distinct().count() >= 28
        starts = folds.starts(chunks, "owner", alerts.Parts(400, "length"))
        assert starts.count() <= 2 * len(sizes)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_caps_of_a_hot_user(spark):
    df, rows = hot(spark)
    for limit, seconds in ((1, 3599), (3, 86400), (5, 600)):
        got = {r["id"]: r["status"] for r in alerts.capped(df, limit, seconds, user="owner", at="ts").collect()}
        sent = defaultdict(list)
        for k, owner, s, _ in sorted(rows, key=lambda r: (r[2], r[0])):
            recent = [t for t in sent[owner] if t >= s - seconds]
            assert got[k] == ("sent" if len(recent) < limit else "digest")
            if len(recent) < limit:
                sent[owner].append(s)
        assert len(got) == len(rows)
    # what a second's rows need is summed before the shuffle
    plan = alerts.capped(df, 3, user="owner", at="ts")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan
    weighed = alerts.capped(df.withColumn("n", F.lit(2)), 3, 600, user="owner", at="ts", rows="n").groupBy("status").count().collect()
    assert {r["status"] for r in weighed} == {"sent", "digest"}
    assert alerts.capped(df.limit(0), 3, user="owner", at="ts").count() == 0


def test_lifecycle_of_a_hot_job(spark):
    rng = random.Random(23)
    names = ["claim", "sent", "error", "retry", "close", "release", "stuck", "expire", "extend", None, "odd"]
    rows = [(k, 1 if k % 2 else rng.randint(2, 30), rng.randrange(3000), rng.choice(names)) for k in range(4000)]
    events = spark.createDataFrame(rows, "event_id long, id long, s long, event string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: (r["status"], r["attempts"], r["ignored"]) for r in steps.lifecycle(events).collect()}
    state = defaultdict(lambda: ["queued", 0, 0])
    for _, job, _, e in sorted(rows, key=lambda r: (r[2], r[0])):
        s = state[job]
        to = steps.MOVES.get((s[0], e))
        if to is None:
            s[2] += 1
        else:
            s[1] = s[1] + 1 if e == "error" else 0 if e == "retry" else s[1]
            s[0] = "failed" if e == "error" and s[1] >= 8 else to
    assert got == {k: tuple(v) for k, v in state.items()}
    assert steps.lifecycle(events.limit(0)).count() == 0


def test_only_keys_at_the_ends_of_chunks_are_composed(spark):
    """All other keys are shown where they are read; a group in Python costs milliseconds a key."""
    rows = [(i, e, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=e), ("claim", "error", "retry", None)[(i + e) % 4]) for i in range(500) for e in range(i % 7 + 1)]
    events = spark.createDataFrame(rows, "id long, event_id long, ts timestamp, event string")
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/tidemill/folded-*"))
    got = {r["id"]: (r["status"], r["attempts"], r["ignored"]) for r in steps.lifecycle(events).collect()}
    moves, wanted = steps.Moves("queued"), {}
    for i, _, _, event in rows:
        at, ignored = wanted.get(i, moves.start)
        go, lost = moves.moved(event)
        wanted[i] = int(go[at]), ignored + int(lost[at])
    assert got == {i: (*moves.states[at], ignored) for i, (at, ignored) in wanted.items()}
    (folder,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/tidemill/folded-*")) - before
    read = spark.read.parquet(folder)
    assert read.where("f is not null").count() <= 2 * read.select("_chunk").distinct().count() < 500 < read.count()
