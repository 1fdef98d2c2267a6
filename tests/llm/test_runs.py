"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

from pyspark.sql import functions as F

from tidemill.llm import periodic_runs as R
from tidemill.llm import queries
from tidemill.session import table


def brute(s, least=R.LEAST, repeats=R.REPEATS):
    """All maximal stretches by every period, the smallest period of each kept."""
    n, out = len(s), set()
    for p in range(1, n // repeats + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, repeats * p):
                t = s[i : i + length]
                if not any(t[: length - q] == t[q:] for q in range(1, p)):
                    out.add((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for start, length, p in runs for i in range(start + p, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_runs_of_random_words():
    random.seed(3)
    for _ in range(600):
        k = random.choice([1, 2, 2, 3, 5])
        s = [random.randint(1, k) for _ in range(random.randint(0, 60))]
        if random.random() < 0.6:
            unit = [random.randint(1, k + 2) for _ in range(random.randint(1, 9))]
            s = s[: len(s) // 2] + (unit * 8)[: random.randint(1, 70)] + s[len(s) // 2 :]
        texts = [[b"w%d" % x for x in s], [b"a"] * random.randint(0, 9), [b"w%d" % x for x in s[::-1]]]
        assert R.runs_of(texts) == [brute(t) for t in texts]
        if s:  # runs of two periods by the trees alone
            ids = sorted(set(s))
            assert R.stretch_runs([ids.index(x) + 1 for x in s], 2, 2) == sorted(brute(s, 2, 2))


def test_extensions_and_lyndon_words():
    random.seed(4)
    for _ in range(60):
        s = [random.randint(1, 3) for _ in range(random.randint(2, 80))]
        ext = R.Extensions(s)
        import numpy as np

        pairs = [(i, j) for i in range(len(s) + 1) for j in range(len(s) + 1) if i != j]
        i, j = (np.array([p[k] for p in pairs]) for k in (0, 1))
        for (x, y), got in zip(pairs, ext.common(i, j).tolist(), strict=True):
            n = 0
            while max(x, y) + n < len(s) and s[x + n] == s[y + n]:
                n += 1
            assert got == n
        for sign, order in zip((1, -1), ext.orders, strict=True):
            want = []
            for a in range(len(s)):
                suffix = [sign * c for c in s[a:]]
                lyndon = [n for n in range(1, len(suffix) + 1) if all(suffix[:n] < suffix[k:n] for k in range(1, n))]
                want.append(max(lyndon))
            assert R.lyndon_lengths(order).tolist() == want


def test_a_long_text_of_one_gap_is_screened_quickly():
    s = [b"w%d" % (i % 60_000) for i in range(200_000)]  # three and a third periods
    assert R.runs_of([s]) == [[]]
    assert R.runs_of([[*s, *(b"w%d" % (i % 60_000) for i in range(200_000, 240_000))]]) == [[(0, 240_000, 60_000)]]


def test_query_equals_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, sf).collect()}
    assert set(got) == set(texts)
    some = 0
    for d, text in texts.items():
        words = text.encode().split()
        h, n = zlib.crc32(str(d).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words) if n < 1500 else R.runs_of([words])[0]
        some += bool(runs)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        r = got[d]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n_},{p}\n" for s, n_, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(kept(words, runs))).hexdigest()
    assert some > 10


def test_cases(spark):
    again = "go on " * 9
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a a a a a a"), (6, again), (6, again), (None, again), (7, "A a A a A a A a x"), (8, "tick tock " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = R.periodic_runs(docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and sum(r["doc_id"] == 6 for r in got) == 2
    assert all(by[d]["n_words"] == 0 and by[d]["runs"] == [] and by[d]["collapsed"] == "" for d in (1, 2, 3))
    assert by[4]["runs"] == [] and [tuple(r) for r in by[5]["runs"]] == [(0, 6, 1)] and by[5]["collapsed"] == "a"
    assert [tuple(r) for r in by[None]["runs"]] == [(0, 18, 2)] and by[6]["collapsed"] == "go on"
    assert [tuple(r) for r in by[7]["runs"]] == [(0, 8, 2)] and by[7]["collapsed"] == "A a x"
    assert [tuple(r) for r in by[8]["runs"]] == [(0, 80_000, 2)]
    more = docs.withColumns({c: F.lit(1) for c in ("id", "runs", "n_words", "collapsed", "words")})
    assert sorted(map(str, R.periodic_runs(more).collect())) == sorted(map(str, got))
    assert R.periodic_runs(docs.limit(0)).count() == 0
