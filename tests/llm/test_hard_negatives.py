import math

import numpy as np
from pyspark.sql import functions as F

from lexweave.llm.hard_negatives import Splits, build_tree, leaf_bounds, mine

SCHEMA = "vec_id long, embedding array<double>, label int, v int, x string, region int, score int, qid int"


def brute(rows, anchors, positives=5, negatives=5, percent=80):
    whole = {}
    for i, v, label in sorted((r for r in rows if r[0] is not None and r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[2], r[1])):
        whole.setdefault(i, (label, [math.floor(256 * x) for x in v]))
    out = set()
    for a in sorted(i for i in whole if i % anchors == 0):
        label, x = whole[a]
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, own) for i, (own, y) in whole.items() if i != a and len(y) == len(x))
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [(n, j) for n, j, own in scored if own != label and percent * -p <= 100 * -n <= 100 * -p][:negatives]
            out |= {(a, i, rank, j, -p, -n) for rank, (n, j) in enumerate(fits, 1)}
    return out


def run(spark, rows, anchors, **kwargs):
    df = spark.createDataFrame([(*r, 0, "", 0, 0, 0) for r in rows], SCHEMA)
    found = [tuple(r) for r in mine(df, F.col("vec_id") % anchors == 0, **kwargs).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_equals_brute_force_on_groups_ties_and_a_hot_region(spark):
    r = np.random.default_rng(7)
    centres = r.normal(size=(6, 8))
    x = [centres[i % 6] + 0.2 * r.normal(size=8) for i in range(500)] + [np.round(centres[0], 1)] * 250
    rows = [(i, [float(c) for c in v], int(r.integers(3))) for i, v in enumerate(x)]
    want = brute(rows, 50)
    assert len(want) > 200
    assert run(spark, rows, 50, block=64, leaf=8) == want
    assert run(spark, rows, 50, block=100, leaf=16, regions=2, sample=20) == want
    assert run(spark, rows, 50, block=64, leaf=8, positives=2, negatives=9, percent=95) == brute(rows, 50, 2, 9, 95)


def test_numbers_beyond_exact_doubles(spark):
    r = np.random.default_rng(8)
    rows = [(i, [float(c) for c in r.normal(size=3) * 1e6], i % 2) for i in range(60)]
    assert run(spark, rows, 10, block=16, leaf=4) == brute(rows, 10)


def test_odd_rows(spark):
    one = [0.5, 1.0]
    rows = [(0, one, 1), (20, one, 1), (7, one, 1), (3, [0.0, 0.0], 2), (4, None, 2), (5, [None, 1.0], 2), (6, [float("nan"), 1.0], 2), (8, [1.0], 2), (9, [0.5, 0.9], 2), (None, one, 2), (9, [0.5, 0.9], 2), (10, one, None), (11, [], 2), (12, [float("inf"), 0.0], 2), (13, one, 2), (14, [0.5, 0.99], 2), (40, [2.0], 2), (41, [0.9], 3), (60, [-1.0, 0.0, 1.0], 1)]
    want = brute(rows, 20)
    assert run(spark, rows, 20) == want and {x[0] for x in want} == {0, 20, 40}
    assert run(spark, [], 20) == set() and run(spark, rows[:1], 20) == set()
    assert run(spark, [(i, [-1.0 if i else 1.0], i % 2) for i in range(9)], 20) == set()  # positives below zero have no window


def test_bounds_hold(spark):
    r = np.random.default_rng(9)
    x = r.integers(-300, 300, (700, 6))
    top = float((x**2).sum(1).max())
    full = np.hstack((x, np.sqrt(top - (x**2).sum(1, keepdims=True))))
    order, vantage, bounds, ends = build_tree(x, top, 16)
    q = np.hstack((r.integers(-300, 300, (20, 6)), np.zeros((20, 1))))
    d = np.sqrt(((q[:, None] - full[None, vantage]) ** 2).sum(2))
    low, high = leaf_bounds(d, bounds)
    assert sorted(order) == list(range(700)) and low.shape[1] == len(ends) == 64
    for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        far = np.sqrt(((q[:, None] - full[None, order[a:b]]) ** 2).sum(2))
        assert (low[:, [k]] <= far + 1e-9).all() and (far <= high[:, [k]] + 1e-9).all()
    splits = Splits(full[:100], 12)
    place = splits.place(full)
    low, high = splits.bounds(q)
    for k in range(len(splits.path)):
        far = np.sqrt(((q[:, None] - full[None, place == k]) ** 2).sum(2))
        assert (low[:, [k]] <= far + 1e-9).all() and (far <= high[:, [k]] + 1e-9).all()
