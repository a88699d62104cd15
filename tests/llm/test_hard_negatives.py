import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kindred.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def mined(df, **more):
    got = hard_negatives.mined(df, F.col("vec_id") % 10 == 0, **more).collect()
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got)


def brute(rows, k=5):
    sound = []
    for i, v, y, _ in rows:
        if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v):
            q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
            if all(abs(x) < 1 << 24 for x in q):
                sound.append((i, q, y))
    out = []
    for a in {i for i, _, _ in sound if i % 10 == 0}:
        _, q, y = min((r for r in sound if r[0] == a), key=lambda r: (r[2], r[1]))
        found = {same: sorted({(-sum(s * t for s, t in zip(q, x)), i) for i, x, z in sound if i != a and (z == y) == same}) for same in (True, False)}
        for score, p in found[True][:k]:
            fit = [(s, i) for s, i in found[False] if -80 * score <= -100 * s <= -100 * score][:k]
            out += [(a, p, n, i, -score, -s) for n, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def random_rows(seed, n, dim=16, spread=1.0):
    rnd = random.Random(seed)
    base = [rnd.gauss(0.3, 1) for _ in range(dim)]
    return [(i, [spread * (b + rnd.gauss(0, 0.7)) for b in base], rnd.randrange(3), "own") for i in range(n)]


def test_equal_to_brute_force(spark):
    rows = random_rows(1, 300)
    rows += [rows[7], rows[20], rows[20], (310, rows[30][1], 1, "equal vector"), (20, rows[40][1], 2, "id again"), (333, rows[33][1][:9], 1, "short"), (340, [], 0, "empty")]
    rows += [(None, [1.0], 1, "x"), (350, None, 1, "x"), (351, [1.0, None], 1, "x"), (352, [float("nan")] * 16, 1, "x"), (360, [float("inf")] * 16, 1, "x"), (370, rows[1][1], None, "x"), (380, [1e9] * 16, 1, "too large")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert len(want) > 100
    assert mined(df) == want
    assert mined(df.coalesce(1)) == want


def test_ties_large_numbers_and_empty_tables(spark):
    ones = [(i, [1.0, -1.0, 0.5], i % 2, "tie") for i in range(60)]
    assert mined(spark.createDataFrame(ones, SCHEMA)) == brute(ones)
    wide = random_rows(2, 80, spread=9000.0)  # products beyond what doubles hold exactly
    assert mined(spark.createDataFrame(wide, SCHEMA)) == brute(wide)
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1, "no anchor")], SCHEMA)) == []
    assert mined(spark.createDataFrame([(0, [1.0], 1, "alone")], SCHEMA)) == []


def test_intervals_drop_most_pairs():
    rnd = np.random.default_rng(3)
    x = np.floor(256 * (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(rnd.normal(size=(4096, 64)))).astype(np.int64)
    label, ids, seen = rnd.integers(0, 10, 4096), np.arange(4096), hard_negatives.Counter()
    a, n = x[:64], 64
    low, high = np.full((n, 1), hard_negatives._LEAST), np.full((n, 1), hard_negatives._MOST)
    ((_, g, r, v),) = hard_negatives.best_in_windows(a, ids[:n], label[:n], low, high, low, x, ids, label, False, 5, seen)
    scores = a @ x.T
    for i in range(n):
        other = np.flatnonzero(label != label[i])
        want = sorted((-scores[i, j], j) for j in other)[:5]
        assert [(-s, j) for s, j in zip(v[g == i], r[g == i])] == want
    assert seen.planes < 2 * n * 4096  # of four planes below the first ones
    assert seen.pairs < 2.5 * n * 4096


def test_whole_numbers_round_down():
    got, sound = hard_negatives.whole_numbers(pa.array([[0.5, -0.001], None, [1.0], [None, 2.0], [2.0**30, 0]], pa.list_(pa.float32())), 256)
    assert got[0].tolist() == [128, -1] and got[2].tolist() == [256, 0]
    assert sound.tolist() == [True, False, True, False, False]
