"""Late rows in streams: posts beside the batch's time, parts after their album."""

import datetime as dt

from tidemill.streaming import admin_alerts, late

T0 = dt.datetime(2024, 1, 1)
POST = "id long, text string, posted_at timestamp, fetched_at timestamp"
PART = "source string, grouped_id long, id long, text string, fetched_at timestamp"


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def test_late_posts_go_to_a_side_table_once(spark, tmp_path):
    source, mark, out = f"{tmp_path}/posts", f"{tmp_path}/mark", f"{tmp_path}/out"
    batches = [[(1, 0, 5), (2, None, 6), (3, None, None)], [(4, 60 * 30, 60 * 30), (5, 60 * 2, 60 * 30)], [(6, 60 * 3, 60 * 4), (7, 60 * 29, 60 * 31)]]
    for rows in batches:
        spark.createDataFrame([(i, "x", at(p), at(f)) for i, p, f in rows], POST).coalesce(1).write.mode("append").parquet(source)
        late.split_late(spark.readStream.schema(POST).parquet(source), out, mark, 24).awaitTermination()
    late.split_late(spark.readStream.schema(POST).parquet(source), out, mark, 24).awaitTermination()
    got = [sorted(r["id"] for r in spark.read.schema(POST).parquet(f"{out}/{t}").collect()) for t in ("on_time", "late")]
    # 5 and 6 are a day behind the newest fetched so far, 6 only by what an earlier batch held
    assert got == [[1, 2, 3, 4, 7], [5, 6]]


def test_late_parts_join_their_album(spark, tmp_path):
    source, mark, out = f"{tmp_path}/parts", f"{tmp_path}/mark", f"{tmp_path}/out"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", admin_alerts.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        batches = [
            [("a", 1, 11, "two", 0), ("a", 1, 10, "one", 0), ("a", 2, 20, "", 0), ("a", None, 30, "no group", 0)],
            [("b", 9, 90, "clock", 10)],
            [("a", 1, 12, "", 11), ("a", 1, 11, "two", 11), ("a", 1, 13, "late", 11)],
            [("b", 9, 91, "clock", 3000)],
            [("a", 1, 14, "another", 3001)],
            [("b", 9, 92, "clock", 9000)],
            [("b", 9, 93, "clock", 9001)],
        ]
        for rows in batches:
            spark.createDataFrame([(s, g, i, t, at(m)) for s, g, i, t, m in rows], PART).coalesce(1).write.mode("append").parquet(source)
            stream = late.albums(spark.readStream.schema(PART).parquet(source), 60, 86400)
            stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
        rows = spark.read.parquet(out).where("source = 'a'").collect()
        got = sorted((r["grouped_id"], r["id"], r["version"], r["n_parts"], r["text"]) for r in rows)
        assert got == [(1, 10, 1, 2, "one\ntwo"), (1, 10, 2, 3, "one\ntwo"), (1, 10, 3, 4, "one\ntwo\nlate"), (1, 14, 1, 1, "another"), (2, 20, 1, 1, "")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
