import numpy as np
from pyspark.sql import functions as F

from lexweave.llm.ann import nearest

SCHEMA = "vec_id long, embedding array<float>, rank int"


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], SCHEMA)


def brute(x, q, k):
    inner = x.astype(np.float64) @ x[q].astype(np.float64)
    order = sorted((j for j in range(len(x)) if j != q), key=lambda j: (-inner[j], j))
    return [(j, inner[j]) for j in order[:k]]


def recall(spark, x, k=20):
    rows = nearest(table(spark, x), F.col("vec_id") % 20 == 0, k=k).collect()
    hits = total = 0
    for q in range(0, len(x), 20):
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, k + 1))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        for r in own:
            assert abs(r.score - float(x[q].astype(np.float64) @ x[r.vec_id].astype(np.float64))) < 1e-12
        hits += len({r.vec_id for r in own} & {j for j, _ in brute(x, q, k)})
        total += k
    return hits / total


def test_recall_on_random_and_skewed_vectors(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, x) >= 0.9
    x[:1000] = x[0] + 0.01 * r.normal(size=(1000, 64))
    x[1500:] *= r.uniform(0.2, 3, (1500, 1))
    assert recall(spark, x) >= 0.9


def test_few_odd_and_equal_vectors(spark):
    rows = [(0, [1.0, 0.0], 0), (20, [1.0, 0.0], 0), (7, [1.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [None, 1.0], 0), (6, [float("nan"), 1.0], 0), (8, [1.0], 0), (9, [0.5, 1.0], 0), (None, [1.0, 0.0], 0), (9, [0.5, 1.0], 0)]
    out = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in out] == [(0, 1, 7), (0, 2, 20), (0, 3, 9), (20, 1, 0), (20, 2, 7), (20, 3, 9)]
    assert nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_all_buckets_are_searched_where_none_are_good_enough(spark, monkeypatch):
    import lexweave.llm.ann as module

    monkeypatch.setattr(module, "fit", lambda *a, **k: None)
    x = np.random.default_rng(2).normal(size=(1500, 16)).astype(np.float32)
    assert recall(spark, x) == 1.0


def test_each_length_by_itself(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(v) for v in r.normal(size=4 if i % 3 else 6)], 0) for i in range(120)]
    out = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=5).collect()
    assert len(out) == 6 * 5 and all((a.query_id % 3 == 0) == (a.vec_id % 3 == 0) for a in out)
