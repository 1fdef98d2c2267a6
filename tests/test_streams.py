"""Stateful operators against plain loops, and stream forms against batch forms."""

import datetime as dt
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tidemill.functions import similarity
from tidemill.operators import alerts, dedup
from tidemill.session import table
from tidemill.sources import feeds
from tidemill.streaming import posts as steps

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_cap_counts_only_sent_rows(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").alias("published_at"))
    got = {r["event_id"]: r["status"] for r in alerts.capped(rows, 2, tie="event_id").collect()}
    sent = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: (r["user_id"], int(r["published_at"].timestamp()), r["event_id"])):
        s = int(r["published_at"].timestamp())
        free = sum(x >= s - 86400 for x in sent[r["user_id"]]) < 2
        assert got[r["event_id"]] == ("sent" if free else "digest")
        if free:
            sent[r["user_id"]].append(s)


def test_parts_are_greedy(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", 3, 4), ("a", 4, 20), ("b", 1, 1)], "owner string, id long, length int")
    got = {(r["owner"], r["id"]): r["part"] for r in alerts.parts(rows, 10).collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, ("a", 3): 1, ("a", 4): 2, ("b", 1): 0}


def test_lifecycle(spark):
    events = [(1, "claim"), (1, "sent"), (1, "claim"), (1, "close"), *[(2, e) for _ in range(8) for e in ("claim", "error")], (2, "retry"), (3, "sent")]
    df = spark.createDataFrame([(i, k, e, at(k)) for k, (i, e) in enumerate(events)], "id long, event_id long, event string, ts timestamp")
    got = {r["id"]: (r["status"], r["attempts"], r["ignored"]) for r in steps.lifecycle(df).collect()}
    assert got == {1: ("closed", 0, 1), 2: ("queued", 0, 0), 3: ("queued", 0, 1)}


def entries(spark, rows):
    schema = "seq long, posted_at timestamp, text string, title string, contacts array<string>, company string"
    e = spark.createDataFrame(rows, schema).withColumn("content_hash", F.sha2("text", 256))
    known = (F.col("title") != "") & (F.size("contacts") > 0)
    return e.withColumn("fingerprint", F.when(known, F.concat_ws("|", "title", F.element_at("contacts", 1))))


LONG = "we look for a careful person who likes to work with people every day in our office"


def test_duplicate_layers(spark):
    day = 24 * 60
    rows = [
        (1, at(0), LONG, "clerk", [], ""),
        (2, at(10 * day), LONG, "clerk", [], ""),
        (3, at(20 * day), LONG, "clerk", [], ""),
        (4, at(40 * day), LONG, "clerk", [], ""),
        (5, at(60 * day), LONG + " and more", "driver wanted", ["@a"], ""),
        (6, at(60 * day + 5), LONG + " and some", "driver wanted", ["@b"], ""),
        (7, at(60 * day + 6), LONG.replace("careful", "calm"), "cook", ["@c"], ""),
        (8, at(61 * day), "short", "x", ["@z"], ""),
        (9, at(61 * day + 1), "shorter", "x", ["@z"], ""),
    ]
    e = entries(spark, rows)
    links = {r["seq"]: (r["parent"], r["layer"]) for r in dedup.parents(e).collect()}
    assert links == {2: (1, "hash"), 3: (2, "hash"), 6: (5, "fuzzy"), 9: (8, "fingerprint")}
    assert {r["seq"]: r["root"] for r in dedup.roots(dedup.same_text(e)).collect()} == {2: 1, 3: 1}


def typos(words, every, rng):
    return " ".join(w[:-1] + rng.choice("xyz") if k % every == 0 else w for k, w in enumerate(words))


def test_fuzzy_layer_equals_all_pairs(spark):
    """Spread typos leave few whole shingles; every earlier post of the window counts."""
    rng, rows = random.Random(5), []
    for k in range(24):
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(80)]
        title = " ".join(words[:4]) if k % 4 else ""
        for copy, every in enumerate((99, 3, 5, 8)):
            t = [title, title + "s", " ".join(title.split()[::-1]), "something else"][copy if k % 3 else 0] if title else ""
            rows.append((len(rows) + 1, at(rng.randint(0, 20 * 24 * 60)), typos(words, every, rng), t, ["@c"] if (k + copy) % 5 == 0 else [], ""))
    short = "a text of forty characters, or just less"
    rows += [(900, at(0), short[:39], "brief", [], ""), (901, at(1), short, "brief", [], "")]
    ratio, want = similarity.ratio_of, {}
    for b in rows:
        for a in rows:
            if a[0] >= b[0] or not dt.timedelta(0) <= b[1] - a[1] <= dt.timedelta(days=14) or len(b[2]) < 40 or (score := ratio(a[2], b[2])) < 85:
                continue
            titles = similarity.token_sort_of(a[3], b[3]) if a[3] and b[3] else None
            alike, shared = titles is not None and titles >= 85, bool({*a[4]} & {*b[4]})
            if (alike and shared) if score < 90 else alike or (shared and (titles is None or titles >= 50)):
                want[b[0]] = min(want.get(b[0], (0, 0)), (-score, a[0]))
    got = {r["seq"]: (-r["score"], r["parent"]) for r in dedup.similar_text(entries(spark, rows)).collect()}
    assert len(want) > 20 and 901 in want
    assert got == want
    assert set(want) <= {r["seq"] for r in dedup.parents(entries(spark, rows)).collect()}


def test_hold_window_stream_equals_batch(spark, tmp_path):
    rows = [(1, 1, 1.0, at(0)), (1, 2, 3.0, at(5)), (1, 3, 9.0, at(25)), (2, 4, 2.0, at(1)), (2, 5, 2.0, at(2)), (9, 6, 1.0, at(300))]
    df = spark.createDataFrame(rows, "root long, seq long, score double, posted_at timestamp")
    batch = {r["root"]: (r["survivor"], r["versions"]) for r in dedup.survivors(df.drop("root"), df.select("seq", "root")).collect()}
    src = str(tmp_path / "in")
    for k in (0, 3, 5):
        df.where(F.col("seq").between(k + 1, {0: 3, 3: 5, 5: 6}[k])).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src).withWatermark("posted_at", "0 seconds")
    q = steps.hold_window(stream).writeStream.format("memory").queryName("held").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["root"]: (r["survivor"], r["versions"]) for r in spark.table("held").collect()}
    assert got == {k: v for k, v in batch.items() if k != 9}


def test_incremental_append_twice_changes_nothing(spark):
    rows = spark.createDataFrame([("a", k) for k in range(10)] + [("b", 5)], "source string, key long")
    cursors = spark.createDataFrame([("a", 3), ("b", None)], "source string, cursor long")
    taken, moved = feeds.fetch_new(rows, cursors, 4)
    assert sorted((r["source"], r["key"], r["is_backfill"]) for r in taken.collect()) == [("a", 4, False), ("a", 5, False), ("a", 6, False), ("a", 7, False), ("b", 5, True)]
    again, last = feeds.fetch_new(rows, moved, 4)
    assert sorted((r["source"], r["key"]) for r in again.collect()) == [("a", 8), ("a", 9)]
    assert {r["source"]: r["cursor"] for r in last.collect()} == {"a": 9, "b": 5}


def test_feeds_share_a_schema(spark):
    payloads = [
        ("himalayas", '{"jobs":[{"guid":"g1","applicationLink":"https://a/1","title":"Cook","companyName":"A","minSalary":10,"maxSalary":20,"pubDate":1714979289,"description":"<p>Hi</p><ul><li>x</li></ul>","locationRestrictions":["Uzbekistan"],"timezoneRestriction":[4,5]}]}'),
        ("remoteok", '[{"legal":"notice"},{"id":"7","position":"Dev","company":"B","salary_min":0,"location":"Worldwide","date":"2024-05-06T07:08:09+00:00"}]'),
        ("hh", '{"items":[{"id":"9","name":"Clerk","employer":{"name":"C"},"salary":{"from":100,"currency":"RUR"},"area":{"name":"Tashkent"}}]}'),
    ]
    jobs = feeds.all_feeds(spark.createDataFrame(payloads, "feed string, payload string"))
    got = {r["external_id"]: r for r in jobs.collect()}
    assert set(got) == {"g1", "7", "9"}
    assert (got["g1"]["currency"], got["g1"]["period"], got["g1"]["description"]) == ("USD", "year", "Hi\n• x")
    assert got["7"]["pay_min"] is None and got["7"]["currency"] is None
    assert (got["9"]["currency"], got["9"]["company"], got["9"]["pay_min"]) == ("RUB", "C", 100)
    opened = jobs.select("external_id", feeds.open_to(F.col("locations"), F.col("timezones"), ["uzbekistan", "worldwide"], 5.0).alias("o")).collect()
    assert {r["external_id"]: r["o"] for r in opened} == {"g1": True, "7": True, "9": False}


def test_source_identifiers(spark):
    given = {"https://t.me/Some_Channel": ("channel", "some_channel"), "@Other": ("channel", "other"), "t.me/+AbCdEfGhIjK": ("invite", "AbCdEfGhIjK"), "https://a.uz/rss.xml": ("feed", "https://a.uz/rss.xml"), "https://site.uz/jobs": ("site", "site.uz"), "??": (None, None)}
    df = spark.createDataFrame([(k,) for k in given], "given string")
    assert {r["given"]: (r["kind"], r["identifier"]) for r in feeds.identify_source(df).collect()} == given


def test_slots_avoid_quiet_hours(spark, sf):
    from tidemill.operators import queue
    from tidemill.plans.views import view

    jobs = view(spark, sf, "jobs").limit(400)
    for start, interval, a, b in (("2024-01-01 12:00:00", 300, 23, 7), ("2024-01-01 23:30:00", 420, 23, 7), ("2024-01-01 03:10:00", 4000, 1, 5), ("2024-01-01 22:59:59", 3600, 23, 7), ("2024-01-01 10:00:00", 500, 0, 0)):
        got = [r["publish_at"] for r in queue.slot_times(jobs, start, interval, a, b).orderBy("rank").collect()]
        t, want = dt.datetime.fromisoformat(start), []
        for k in range(len(got)):
            t += dt.timedelta(seconds=interval if k else 0)
            quiet = a != b and ((t.hour >= a or t.hour < b) if a > b else a <= t.hour < b)
            if quiet:
                end = t.replace(hour=b, minute=0, second=0)
                t = end if end > t else end + dt.timedelta(days=1)
            want.append(t)
        assert got == want


def test_source_types_are_registered(spark, tmp_path):
    import pytest

    from tidemill.sources import registry

    rss = """<rss><channel><item><guid>g</guid><title>T</title><link>https://a/1</link><description>&lt;p&gt;x&lt;/p&gt;</description><pubDate>Mon, 06 May 2024 07:08:09 GMT</pubDate></item></channel></rss>"""
    (tmp_path / "f.xml").write_text(rss)
    got = registry.read(spark, "rss", f"file://{tmp_path}/f.xml").collect()
    assert [(r["title"], r["text"], r["url"], len(r["external_id"])) for r in got] == [("T", "x", "https://a/1", 20)]
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>1</id><title>T</title><link rel="self" href="https://a/s"/><link rel="alternate" href="https://a/1"/><summary>s</summary></entry></feed>"""
    (tmp_path / "a.xml").write_text(atom)
    assert [(r["title"], r["text"], r["url"]) for r in registry.read(spark, "atom", f"file://{tmp_path}/a.xml").collect()] == [("T", "s", "https://a/1")]
    (tmp_path / "f.json").write_text('{"jobs":[{"guid":"1","title":"A"},{"guid":"2"}]}')
    assert registry.read(spark, "himalayas", f"file://{tmp_path}/f.json").count() == 1
    with pytest.raises(ValueError):
        registry.read(spark, "nothing", "x")


def test_messages_and_albums(spark):
    schema = "id long, text string, entities array<struct<offset:int,length:int,url:string>>, buttons array<struct<text:string,url:string>>, media string"
    rows = [(1, "see here now", [(4, 4, "https://a")], [("Go", "https://b"), ("No", None)], None), (2, "", [], [], None), (3, None, None, None, "photo")]
    got = {r["id"]: r for r in feeds.flatten_message(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {1, 3}
    assert [tuple(x) for x in got[1]["links"]] == [("here", "https://a")] and [tuple(x) for x in got[1]["buttons"]] == [("Go", "https://b")]
    assert got[3]["media"] == "photo" and got[3]["links"] == []
    parts = spark.createDataFrame([("s", 1, 11, "b", at(0)), ("s", 1, 10, "a", at(0.5)), ("s", 1, 12, "", at(0.9)), ("s", 1, 13, "late", at(5))], "source string, grouped_id long, id long, text string, fetched_at timestamp")
    merged = sorted((r["id"], r["text"], r["n_parts"]) for r in steps.albums(parts).collect())
    assert merged == [(10, "a\nb", 3), (13, "late", 1)]


def test_lists_of_positions(spark):
    from tidemill.operators import extract

    rows = extract.lines(spark.createDataFrame([(1, "We hire:\n1. Cook https://a/1\n2) Driver https://a/2\n- cook https://a/1"), (2, "Cook https://a/9")], "id long, text string"))
    assert sorted((r["pos"], r["position"], r["url"]) for r in extract.linked_positions(rows).collect()) == [(1, "Cook", "https://a/1"), (2, "Driver", "https://a/2"), (3, "cook", "https://a/1")]
    found = extract.positions(extract.lines(spark.createDataFrame([(1, "1. Cook\n2) Driver\n- cook"), (2, "- cook")], "id long, text string")), ["cook", "driver"]).collect()
    assert [(r["id"], r["positions"]) for r in found] == [(1, ["Cook", "Driver"])]


BASE = "Seller wanted\nPay 6 200 000 so'm\nHours 10 00 19 00\nPlace river street seven beside the old mill\nAge 22 40 years two languages"
WORDS = dedup.TitleWords(roles=("expert", "tutor", "wanted", "boss"), fillers=("of", "and"))


def test_duplicate_rules(spark):
    """Each pair of posts, an hour apart: the layer that links them, or none."""
    more = BASE.replace("two languages", "two languages well")
    spelled = BASE.replace("river", "rriver").replace("Hours", "hhours") + " and there is also one more thing that is told here with other words"
    cases = [
        ((BASE, "seller", [], ""), (BASE, "seller", [], ""), "hash"),
        ((BASE, "seller", [], ""), (more, "baker", [], ""), None),
        ((BASE, "seller", [], ""), (more, "seller", [], ""), "fuzzy"),
        ((BASE, "seller wanted", ["+998935112207"], ""), (more, "sellers", ["+998935112207"], ""), "fuzzy"),
        ((BASE, "seller", ["@olim"], ""), (more, "accountant's help", ["@olim"], ""), None),
        ((BASE, "seller", ["@olim"], ""), ("A new branch opens, 3 shifts, beds for all, free lunch, nothing else to say", "seller", ["@olim"], ""), None),
        ((BASE, "Seller expert", ["@olim"], "A"), (spelled, "selller wanted", ["@olim"], "A"), "contact"),
        ((BASE, "Seller expert", ["@olim"], "Alpha"), (spelled, "selller wanted", ["@olim"], "Omega"), None),
        ((BASE, "Physics tutor", ["@olim"], ""), (spelled, "Botany tutor", ["@olim"], ""), None),
        ((BASE, "expert", ["@olim"], ""), (spelled, "boss", ["@olim"], ""), None),
    ]
    for k, (first, second, layer) in enumerate(cases):
        e = entries(spark, [(1, at(0), *first), (2, at(60), *second)])
        got = [(r["seq"], r["parent"], r["layer"]) for r in dedup.parents(e, words=WORDS).collect()]
        assert got == ([(2, 1, layer)] if layer else []), k


def test_common_subsequences_of_many_pairs():
    import numpy as np

    rng = random.Random(13)
    a, b = (["".join(rng.choices("abcé ", k=rng.choice([0, 1, 5, 63, 64, 65, 130]))) for _ in range(30)] for _ in range(2))
    i, j = (np.array([rng.randrange(30) for _ in range(400)]) for _ in range(2))
    got = dedup.lcs_lengths(a, b, i, j).tolist()
    assert got == [similarity._lcs(a[x], b[y]) for x, y in zip(i.tolist(), j.tolist())]
    for x, y in (("abcdefgh" * 9, "abcdefgh" * 8 + "zzabcdefgh"), ("q" * 50, "")):
        gap = len(x) + len(y) - 2 * similarity._lcs(x, y)
        assert int(np.abs(dedup.sketch(x) - dedup.sketch(y)).sum()) <= (2 * dedup.SKETCH_GRAM - 1) * gap


def test_blocks_of_any_size_give_the_same_links(spark, monkeypatch):
    """Many later posts with many similar earlier ones, dealt to blocks of a few rows."""
    rng, rows = random.Random(12), []
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(40)]
    for k in range(120):
        t = list(words)
        for i in rng.sample(range(40), rng.randint(0, 3)):
            t[i] = "".join(rng.choices("klmnop", k=4))
        rows.append((k + 1, at(rng.randint(0, 30 * 24 * 60)), " ".join(t), " ".join(t[:3]), [rng.choice(["@a", "@b", "@c"])], ""))
    whole = sorted(map(tuple, dedup.parents(entries(spark, rows)).collect()))
    monkeypatch.setattr(dedup, "BLOCK", 7)
    monkeypatch.setattr(dedup, "TOGETHER", 2)
    monkeypatch.setattr(dedup, "BROADCAST_PAIRS", -1)
    assert sorted(map(tuple, dedup.parents(entries(spark, rows)).collect())) == whole and len(whole) > 60


def test_links_tags_and_own_accounts_do_not_count(spark):
    rows = spark.createDataFrame([(1, BASE + "\n#toshkent\n@kanal_bir", ["@Kanal_Bir"]), (2, BASE + "\nhttps://t.me/x?y=1\n@kanal_ikki", ["kanal_ikki"]), (3, BASE + " @kanal_bir_x", ["@kanal_bir"]), (4, BASE + " @x", None)], "id long, text string, own array<string>")
    posts = rows.withColumn("posted_at", F.lit(T0)).withColumn("fetched_at", F.lit(T0))
    from tidemill.functions import contacts

    e = {r["seq"]: r for r in dedup.entries(posts, contacts.accounts(F.col("text")), own=F.col("own")).collect()}
    assert e[1]["content_hash"] == e[2]["content_hash"] != e[3]["content_hash"]
    assert e[1]["contacts"] == [] and e[3]["contacts"] == ["@kanal_bir_x"]


def test_contact_layer_equals_all_pairs(spark):
    rng, rows = random.Random(9), []
    roles = ["driver", "cook", "night driver", "head cook", "clerk"]
    base = [["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(30)] for _ in range(4)]
    for k in range(40):
        words = list(base[k % 4])
        for i in rng.sample(range(30), rng.randint(0, 14)):
            words[i] = "".join(rng.choices("klmnop", k=5))
        rng.shuffle(words)
        rows.append((k + 1, at(rng.randint(0, 18 * 24 * 60)), " ".join(words), rng.choice(roles), [rng.choice(["@a", "@b"])], rng.choice(["", "Firm", "Other"])))


    def one(t):
        return re.sub(r"(\w)\1+", r"\1", t.lower().replace("x", "h").replace("q", "k"))

    want = {}
    for b in rows:
        for a in rows:
            if a[0] >= b[0] or not dt.timedelta(0) <= b[1] - a[1] <= dt.timedelta(days=14) or not {*a[4]} & {*b[4]}:
                continue
            if a[5] and b[5] and similarity.ratio_of(one(a[5]), one(b[5])) < 80 or similarity.token_set_of(one(a[3]), one(b[3])) < 85:
                continue
            if (score := similarity.token_set_of(one(a[2]), one(b[2]))) >= 75:
                want[b[0]] = min(want.get(b[0], (0, 0)), (-score, a[0]))
    got = {r["seq"]: (-r["score"], r["parent"]) for r in dedup.same_contact(entries(spark, rows)).collect()}
    assert len(want) > 5 and got == want


def test_flow_takes_over_and_caps(spark):
    from tidemill.operators import flow

    rules = flow.Rules({"job": ["wanted", "pay", "age"], "scam": ["deposit"]}, international_a_day=1, professions=["seller"])
    ad = BASE.replace("Pay", "Pay:")
    full = ad + "\nTel 93 511 22 07"
    rows = [
        (1, ad + "\n@hr_person", 0, False, False), (2, full + "\n@hr_person", 10, False, False), (3, full + "\n@hr_person ", 40, False, False),
        (4, "", 1, False, False), (5, None, 2, True, False), (6, "Baker wanted, with a deposit", 3, False, False), (7, "Seller wanted\nPay as agreed", 4, False, False),
        (8, "Cook wanted\nPosition: cook\n@abroad_one", 5, True, True), (9, "Driver wanted\nPosition: driver\n@abroad_two", 6, True, True), (10, "wanted pay @hr_person", 7, False, False),
    ]
    posts = spark.createDataFrame([(i, "s", t, at(m), at(m), False, s, x) for i, t, m, s, x in rows] + [(11, "s", full, at(0), at(0), True, False, False)], "id long, source string, text string, posted_at timestamp, fetched_at timestamp, is_backfill boolean, is_site boolean, international boolean")
    got = {r["id"]: r["status"] for r in flow.flow(posts, rules, F.lit(T0)).collect()}
    assert got == {1: "duplicate", 2: "done", 3: "duplicate", 4: "no_text", 5: "no_contact", 6: "suspicious", 7: "no_contact", 8: "done", 9: "skipped_limit", 10: "low_quality", 11: "skipped_backfill"}
    assert {r["status"]: r["n"] for r in flow.counters(flow.flow(posts, rules, F.lit(T0))).collect()}["duplicate"] == 2
