import random

import brute
from lexweave.llm.common import materialize
from lexweave.llm.jaccard_join import _with_pivots, jaccard_components, keep_one


def near_copies(seed, groups=12, copies=8):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, n = [], 0
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 5, 12, 40, 90]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.3:
                w += r.choices(vocabulary, k=r.randrange(8))
            rows.append((n * 7 % 1000, " ".join(w)))
            n += 1
    return rows


def test_equals_brute_force(spark):
    rows = near_copies(1) + [(2001, None), (2002, ""), (2003, " \t\n"), (2004, "One"), (2005, "one"), (2006, "a b c d"), (2007, "A  B\tc\nd")]
    boiler = " ".join(f"b{i}" for i in range(30))
    rows += [(3000 + i, boiler + " " + " ".join(f"u{i}x{j}" for j in range(i % 9))) for i in range(40)]
    docs = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], "doc_id long, text string, tok string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == brute.jaccard_components(rows)


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(empty).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(docs).collect())) == [(1, 2, 1), (2, 2, 1)]
    assert sorted(r.doc_id or 0 for r in keep_one(docs).collect()) == [0, 1, 1]


def test_rows_of_a_frequent_shingle_are_split(spark):
    knobs = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in knobs}
    for k, v in knobs.items():
        spark.conf.set(k, v)
    try:
        src = materialize(spark.range(40_000).selectExpr("if(id % 10 = 0, id div 20, -1L) as tok", "0 as pos", "id as rep", "100 as n", "cast(null as long) as label"))
        met, pivots = _with_pivots(src, 0, 80)
        rows = met.collect()
        assert "skew=true" in met._jdf.queryExecution().executedPlan().toString()
        assert len(rows) == 36_000 - 1 + 2_000 and pivots.count() == 2_001
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
