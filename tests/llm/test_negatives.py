"""Hard negatives: brute force over vectors of any size, ties, repeats and odd input; the bounds of the index."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import hard_negatives as H
from tidemill.llm.topk import quantised

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, every=10):
    rows = [(i, c, quantised(v, H.SCALE)) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda s: min(max(s, H.LEAST_LONG), H.MOST_LONG)
    out = []
    for i, c, v in {(i, c, tuple(v)) for i, c, v in rows if i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, e) for j, e, w in rows if j != i and len(w) == len(v))
        for s, j, _ in [r for r in scored if r[2] == c][: H.K]:
            window = [r for r in scored if r[2] != c and H.LEAST * -s <= 100 * -r[0] <= H.MOST * -s][: H.K]
            out += [(i, j, k, n, clip(-s), clip(-t)) for k, (t, n, _) in enumerate(window, 1)]
    return sorted(out)


def got(spark, rows, every=10):
    found = H.hard_negatives(spark.createDataFrame(rows, SCHEMA), f"vec_id % {every} = 0")
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def test_clusters_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 64)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 20))
    rows = [(int(k), int(rng.integers(0, 4)), (centres[k % 6] + rng.normal(size=20) * (0.3 if k % 3 else 0.0)).round(2).tolist()) for k in range(300)]
    rows += [rows[10], rows[20], (30, 2, rows[31][2]), (31, 0, rows[40][2])]
    assert got(spark, rows) == brute(rows)


def test_any_width_and_size(spark):
    random.seed(7)
    vector = lambda n, size: [random.uniform(-1, 1) * size for _ in range(n)]
    rows = [(k, k % 3, vector(random.choice([1, 3, 9, 17]), random.choice([1, 1, 1, 50, 1e5, 1e40]))) for k in range(250)]
    rows += [(500 + k, k % 2, []) for k in range(12)] + [(600, 1, vector(300, 1.0)), (601, 1, vector(300, 1.0)), (602, 0, vector(300, 1.0))]
    rows += [(700, None, vector(3, 1)), (None, 1, vector(3, 1)), (710, 1, None), (720, 1, [1.0, None, 2.0]), (730, 1, [1.0, float("nan"), 2.0]), (740, 1, [float("inf"), 0.0, 0.0])]
    assert got(spark, rows) == brute(rows)


def test_empty_and_clashing(spark):
    assert got(spark, []) == [] and got(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == []
    rows = [(k, k % 2, [1.0, k / 50]) for k in range(50)]
    more = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("v", "width", "norm", "block", "anchor", "top", "score", "ids", "is_wide", "n_narrow")})
    found = H.hard_negatives(more, "vec_id % 10 = 0")
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_thresholds_keep_all_that_reach_them():
    rng = np.random.default_rng(8)
    values = rng.integers(-200, 200, size=(500, 64)).astype(np.int32)
    values[:, 40:] //= 20
    block = H.Block(values)
    queries = [[int(x) for x in values[k]] for k in range(0, 40, 2)]
    scores = np.array(queries) @ values.T
    for share in (0.9, 0.5, 0.1, None):
        least = [None if share is None else int(s.max() * share) for s in scores]
        i, j, s = block.reaching(queries, least, np.ones(scores.shape, dtype=bool))
        want = {(a, b): int(scores[a, b]) for a in range(len(queries)) for b in range(500) if least[a] is None or scores[a, b] >= least[a]}
        assert dict(zip(zip(i.tolist(), j.tolist(), strict=True), s, strict=True)) == want


def test_scores_sort_as_texts():
    numbers = sorted([0, 1, -1, 9, 10, -10, 99, 10**30, -(10**30), 2**63, -(2**63), 12345])
    assert sorted(numbers, key=H._text) == numbers and [H._number(H._text(n)) for n in numbers] == numbers
