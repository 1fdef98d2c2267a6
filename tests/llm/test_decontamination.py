"""Benchmark windows: forms with and without broadcasts against brute force, and odd input."""

import random

from pyspark.sql import functions as F

from tidemill.llm import decontamination as D


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = D.split_words(text)
        n = min(len(w), D.WINDOW)
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w = D.split_words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((d, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(map(str, out))


def shown(found):
    rows = found.collect()
    for r in rows:
        assert sum(s["length"] for s in r["spans"]) == r["n_hit"]
        assert all(a["start"] + a["length"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    return sorted(str((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]))) for r in rows)


def test_equals_brute_force_with_and_without_broadcasts(spark):
    random.seed(5)
    vocabulary = ["ab", "Cd", "é", "x1", "zz"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(k, text(random.choice([1, 4, 9, 10, 11, 30, 40]) if k > 3 else 30)) for k in range(40)]
    items[1] = (1, " ".join(items[0][1].split()[5:]) + " tail of its own")  # shares windows
    items += [(0, text(12)), (77, items[5][1]), (78, "... !"), (79, None)]
    docs = []
    for k in range(300):
        parts = [text(random.randint(0, 30))]
        for _ in range(random.randint(0, 3)):
            words = random.choice(items)[1]
            words = (words or "").split()
            lo = random.randint(0, max(len(words) - 5, 0))
            parts += [", ".join(words[lo : lo + random.randint(5, 40)]).upper() if random.random() < 0.5 else " ".join(words[lo:]), text(random.randint(0, 5))]
        docs.append((k // 2, " ".join(parts)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert shown(D.find_passages(d, b)) == want
    assert shown(D.find_passages(d, b, broadcast_windows=-1)) == want


def test_a_full_bitmap_loses_and_adds_nothing(spark, monkeypatch):
    monkeypatch.setattr(D, "BITS", 6)
    items = [(k, " ".join(f"t{k}x{i}" for i in range(25))) for k in range(30)]
    docs = [(k, f"x {items[k % 30][1]} y " + " ".join(f"o{k}x{i}" for i in range(40))) for k in range(90)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert shown(D.find_passages(d, b)) == brute(docs, items)


def test_cases(spark):
    long_ = "one two three four five six seven eight nine ten"
    docs = [(1, None), (2, ""), (3, " ,.;"), (4, "A short-item here"), (5, long_ + " eleven"), (5, long_ + " eleven"), (None, long_), (6, ("pad " * 30_000) + long_), (7, "one two three four five six seven eight nine")]
    items = [(1, "SHORT item"), (2, long_), (None, "here"), (3, None), (4, "-"), (2, "four five")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = D.find_passages(d, b)
    assert shown(got) == brute(docs, items)
    clash = {c: F.lit(1) for c in ("id", "words", "start", "len", "fp", "digest", "set", "item", "items", "at")}
    assert shown(D.find_passages(d.withColumns(clash), b.withColumns({c: F.lit(1) for c in ("item", "fp", "digest", "set", "len")}))) == shown(got)
    assert shown(D.find_passages(d, b.limit(0))) == brute(docs, [])
    assert D.find_passages(d.limit(0), b).count() == 0
    assert D.digests(got).where("doc_id = 5").first()["items_sha256"] == D.digests(got).where("doc_id = 5").collect()[1]["items_sha256"]
