import random
from collections import defaultdict

import pytest

from lexweave.llm.mixing import mix

SCHEMA = "doc_id long, source string, text string, pos int, size string, m int, s int, target int, x int, n int"


def run(spark, rows, **kwargs):
    df = spark.createDataFrame([(*r, 0, "", 0, 0, 0, 0, 0) for r in rows], SCHEMA)
    return mix(df, **kwargs).collect()


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Resharing by hand: what is above a bound goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    held, left = {}, sum(sizes.values()) * share
    while True:
        free = [s for s in order if s not in held]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return {s: held.get(s, left * weight[s] / total if s in free else 0) for s in order}
        for s in over:
            held[s] = most * sizes[s]
        left = sum(sizes.values()) * share - sum(held.values())


def test_targets_are_met_and_copies_are_whole(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "b", "b", "b", "c", "Z", "é", None]), "w " * int(r.lognormvariate(4, 1.3)) if r.random() < 0.95 else "") for i in range(6000)]
    out = run(spark, rows)
    assert len(out) == len(rows)
    source = {i: s for i, s, _ in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, s, t in rows:
        sizes[s] += len(t.split())
    want = targets(sizes)
    for x in out:
        s = source[x.doc_id]
        taken[s] += x.taken
        assert x.source_size == sizes[s] and abs(x.target - want[s]) < 1e-6 * want[s]
        assert x.size == len(rows[x.doc_id][2].split())
        copies = x.target / x.source_size
        if x.size:
            assert x.taken % x.size == 0 and int(copies) <= x.taken // x.size <= min(2, int(copies) + 1)
    for s in sizes:
        largest = max(x.size for x in out if source[x.doc_id] == s)
        assert abs(taken[s] - want[s]) <= min(largest / 2, 0.02 * want[s]), (s, taken[s], want[s])
    again = {x.doc_id: x.taken for x in run(spark, list(reversed(rows)))}
    assert again == {x.doc_id: x.taken for x in out}


def test_every_document_has_its_probability(spark):
    rows = [(i, "a" if i < 300 else "b", "w " * (1 + i % 7)) for i in range(400)]
    counts = defaultdict(int)
    for seed in range(12):
        for x in run(spark, rows, weights=(1, 1), share=1.0, seed=seed):
            counts[x.doc_id] += x.taken // x.size if x.size else 0
    small = [counts[i] / 12 for i in range(300)]
    ratio = targets({"a": sum(1 + i % 7 for i in range(300)), "b": sum(1 + i % 7 for i in range(300, 400))}, (1, 1), 1.0)["a"] / sum(1 + i % 7 for i in range(300))
    assert abs(sum(small) / 300 - ratio) < 0.02
    by_size = [sum(small[i] for i in range(300) if i % 7 == k) / len(range(k, 300, 7)) for k in range(7)]
    assert all(abs(b - ratio) < 0.15 for b in by_size)  # large and small ones alike


def test_a_very_large_document_costs_half_of_it_at_most(spark):
    rows = [(i, "b" if i % 4 else "a", "w " * (10_000 if i == 4 else 1 + i % 50)) for i in range(800)]
    out = run(spark, rows)
    for s in ("a", "b"):
        own = [x for x in out if (rows[x.doc_id][1] == s)]
        assert abs(sum(x.taken for x in own) - own[0].target) <= (5000 if s == "a" else 25)


def test_odd_rows(spark):
    rows = [(1, "a", None), (2, "a", ""), (None, "a", "x y"), (None, "a", "x y"), (3, None, "x"), (3, None, "x"), (4, "only empty", " \t"), (5, "long", "w " * 200_000)]
    out = run(spark, rows)
    assert len(out) == len(rows) and all(0 <= x.taken <= 2 * x.size for x in out)
    assert {x.size for x in out if x.doc_id in (1, 2, 4)} == {0}
    assert run(spark, []) == []
    assert sum(x.taken for x in run(spark, [(i, "s", "w") for i in range(1000)])) == 1500
    same = run(spark, [(7, "s", "a b c")] * 500)
    assert sum(x.taken for x in same) == 2250
    with pytest.raises(ValueError):
        run(spark, [], weights=())
