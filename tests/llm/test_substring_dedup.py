import random
import time

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import substring_dedup
from lexweave.llm.substring_dedup import _apart, _signed, _windows, compact_windows, find_passages, near_centres, without_passages


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 30), min_size=1, max_size=40), min_size=1, max_size=4), st.integers(1, 9))
def test_windows_cover_each_subsequence_once(docs, t):
    h = np.array([x for d in docs for x in [*d, 0]], np.uint64)
    got = {(int(a), int(b), int(c)) for a, b, c in zip(*compact_windows(h, t), strict=True)}
    base = 0
    for d in docs:
        for i in range(len(d)):
            for j in range(i + t - 1, len(d)):
                own = d[i : j + 1]
                c = base + i + own.index(min(own))
                held = [w for w in got if w[0] <= base + i <= w[1] <= base + j <= w[2]]
                assert len(held) == 1 and held[0][1] == c
        base += len(d) + 1
    assert all(r - l + 1 >= t for l, _, r in got)


def planted(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randrange(2, 8)))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(51), text(60), text(90)]
    line = text(10)
    docs, holders = [], {k: [] for k in range(3)}
    for i in range(120):
        w = text(r.randrange(20, 200))
        if i % 3 == 0:
            w += line + text(20)
        if i % 4 == 1:
            k = r.randrange(3)
            p = list(passages[k])
            if k == 2 and r.random() < 0.5:
                p[r.randrange(30, 60)] = "changed"
            w = w + p + text(r.randrange(30))
            holders[k].append(i)
        docs.append((i, " ".join(w)))
    return docs, holders


def test_finds_planted_passages_and_nothing_else(spark):
    docs, holders = planted()
    rows = docs + [(500, None), (501, ""), (502, "a b"), (None, docs[0][1])]
    found = find_passages(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, v int")).collect()
    later = {d for own in holders.values() for d in own[1:]}
    assert {r.doc_id for r in found} == later
    texts = dict(docs)
    for r in found:
        a = set(brute.shingles(" ".join(brute.words(texts[r.doc_id])[r.start_word : r.end_word])))
        b = set(brute.shingles(" ".join(brute.words(texts[r.source_id])[r.source_start : r.source_end])))
        assert r.source_id < r.doc_id and r.end_word - r.start_word >= 50
        assert abs(len(a & b) / len(a | b) - r.similarity) < 1e-9 and r.similarity >= 0.8


def test_exact_copies_are_cut_whole(spark):
    docs, _ = planted(5)
    rows = [docs[0], (900, docs[0][1]), (901, docs[0][1]), (902, "short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in without_passages(df).collect()}
    n = len(docs[0][1].split())
    assert out[0] == docs[0][1] and out[902] == "short text"
    assert n < 50 or (out[900].strip() == "" and out[901].strip() == "")


def test_empty_table(spark):
    assert find_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randrange(2, 8)))
    return r, lambda n: [word() for _ in range(n)]


def test_holders_of_fragments_do_not_stand_between(spark):
    docs, _ = [], None
    for case in range(12):
        r, text = texts(case)
        p = text(60)
        base = 1000 * case
        if case % 3 == 0:  # every shingle has an earlier holder of its own
            docs += [(base + k, text(80) + p[k : k + 5] + text(80)) for k in range(56)]
        elif case % 3 == 1:  # two halves
            docs += [(base, text(60) + p[:30] + text(60)), (base + 1, text(60) + p[30:] + text(60))]
        else:  # overlapping thirds
            docs += [(base + k, text(60) + p[20 * k : 20 * k + 25] + text(60)) for k in range(3)]
        docs += [(base + 900, text(40) + p + text(30)), (base + 901, text(10) + p + text(70))]
    found = find_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source_id) for r in found} == {(1000 * k + 901, 1000 * k + 900) for k in range(12)}
    assert all(r.end_word - r.start_word >= 60 for r in found)


def test_recall_of_near_passages_against_brute_force(spark):
    docs, near, clean = [], [], []
    for case in range(200):
        r, text = texts(100 + case)
        p = text(r.randrange(52, 200))
        q = list(p)
        for _ in range(r.randrange(1, 2 + len(p) // 45)):
            k = r.randrange(2, len(q) - 2)
            q[k : k + 1] = r.choice([[], ["changed"], ["two", "more"]])
        docs += [(2 * case, text(r.randrange(80)) + p + text(r.randrange(80))), (2 * case + 1, text(r.randrange(80)) + q + text(r.randrange(80)))]
        a, b = (brute.shingles(" ".join(w)) for w in (p, q))
        if min(len(p), len(q)) >= 50 and len(a & b) >= 0.8 * len(a | b):
            near.append(2 * case + 1)
        clean.append(2 * case)
    found = {r.doc_id for r in find_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")).collect()}
    assert len(near) > 120 and len(found & set(near)) >= 0.95 * len(near) and not found & set(clean)


def test_many_holders_repeated_rows_and_long_texts(spark):
    r, text = texts(9)
    p, long = text(70), text(30_000)
    docs = [(k, text(20) + p + text(20)) for k in range(300)] + [(400, long), (401, text(30) + long[5_000:25_000]), (402, ["same"] * 30_000), (403, ["same"] * 30_000)]
    rows = [(d, " ".join(w), 1) for d, w in docs] + [(299, " ".join(docs[299][1]), 1)]
    found = find_passages(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect()
    assert {d for r in found for d in [r.doc_id] if d < 400} == set(range(1, 300)) and {(x.doc_id, x.source_id) for x in found if x.doc_id >= 400} == {(401, 400), (403, 402)}
    assert next(x for x in found if x.doc_id == 401).end_word - next(x for x in found if x.doc_id == 401).start_word == 20_000


@pytest.mark.parametrize("copies", [60, 300])
def test_noisy_copies_do_not_hide_an_exact_passage(spark, copies):
    r = random.Random(copies)
    rows, want, n = [], {}, 0
    for case in range(30):
        fresh = lambda k, case=case: [f"c{case}x{r.randrange(10**6)}" for _ in range(k)]
        passage = fresh(60)
        for _ in range(copies):
            rows.append((n, " ".join(w if r.random() > 0.15 else fresh(1)[0] for w in passage)))
            n += 1
        rows += [(n + k, " ".join(fresh(30) + passage + fresh(30))) for k in range(2)]
        want[n + 1] = n
        n += 2
    found = {}
    for x in find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(x.doc_id, []).append(x)
    exact = 0
    for later, source in want.items():
        own = found.get(later, [])
        assert any(x.start_word <= 38 and x.end_word >= 82 for x in own), later
        exact += any(x.source_id == source and x.start_word <= 30 and x.end_word >= 90 for x in own)
    assert exact >= 20  # in others a noisy copy that is near enough explains the centre


def test_noisy_copies_do_not_hide_a_near_passage(spark):
    r = random.Random(7)
    rows, want, n = [], [], 0
    for case in range(30):
        fresh = lambda k, case=case: [f"c{case}x{r.randrange(10**6)}" for _ in range(k)]
        passage = fresh(60)
        for _ in range(60):
            rows.append((n, " ".join(w if r.random() > 0.2 else fresh(1)[0] for w in passage)))
            n += 1
        changed = passage[:30] + fresh(1) + passage[31:]
        rows += [(n, " ".join(fresh(30) + passage + fresh(30))), (n + 1, " ".join(fresh(30) + changed + fresh(30)))]
        want.append(n + 1)
        n += 2
    found = {x.doc_id for x in find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found & set(want)) >= 28


def test_centres_are_near_by_the_shingles_around_them():
    r = np.random.default_rng(5)
    text = lambda n: r.integers(0, 40, n).astype(np.uint32)
    for t, need in ((6, 4), (10, 9), (46, 41)):
        b = [text(int(n)) for n in r.integers(1, 2 * t, 9)]
        a = [text(int(n)) for n in r.integers(1, 2 * t, 30)] + [x.copy() for x in b[:3]]
        i, j = near_centres([x.tobytes() for x in b], [x.tobytes() for x in a], t, need)
        most = lambda x, y, t=t: max(np.isin(x, y)[k : k + t].sum() for k in range(len(x)))
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(k, m) for k, x in enumerate(b) for m, y in enumerate(a) if most(x, y) >= need}


def once_and_row_by_row(make, batch):
    """Rows of ``make()`` over a batch, and the CPU seconds for it at once and in batches of one row."""
    seconds, rows = [], []
    for parts in ([batch], [batch.slice(k, 1) for k in range(batch.num_rows)]):
        begin = time.process_time()
        out = list(make()(iter(parts)))
        seconds.append(time.process_time() - begin)
        rows.append(sorted(x for b in out for x in zip(*(c.to_pylist() for c in b.columns), strict=True)))
    assert rows[0] == rows[1] and rows[0]
    return seconds


def test_signatures_of_many_documents_are_made_at_once():
    r = random.Random(1)
    texts = [" ".join(r.choices(["a", "b", "c d"] if i % 50 == 0 else [str(k) for k in range(3000)], k=r.randrange(60, 200))) for i in range(2000)]
    made = pa.Table.from_batches(_windows(4, 46)(iter([pa.record_batch({"doc_id": pa.array(range(2000), pa.int64()), "text": texts})])))
    own = made.to_pandas().groupby("doc_id")[["v", "w"]].agg(list)
    spans = [[{"a": 10, "b": 70, "exact": i % 6 == 0}, {"a": 40, "b": 90, "exact": True}] if i % 3 == 0 else None for i in range(len(own))]
    lists = [pa.array(own[c].tolist(), pa.list_(pa.int64())) for c in ("v", "w")]
    batch = pa.record_batch([pa.array(own.index.to_numpy()), *lists, pa.array(spans, pa.list_(pa.struct({"a": pa.int32(), "b": pa.int32(), "exact": pa.bool_()})))], names=["doc_id", "vs", "ws", "spans"])
    once, alone = once_and_row_by_row(lambda: _signed(4, 46, [(0, 1), (0, 2), (1, 3)]), batch)
    assert once * 3 < alone


def test_small_packs_are_compared_at_once():
    r = np.random.default_rng(2)
    texts = [r.integers(0, 1 << 32, 91, dtype=np.uint32) for _ in range(300)]

    def member(k):
        x = texts[k % 300].copy()
        x[: k // 300] = 0
        return {"doc_id": k, "c": 45, "w": x.tobytes()}

    rows = [([member(int(k) + 600)], [member(int(k)), member(int(r.integers(600)))]) for k in r.integers(0, 600, 3000)]
    kind = pa.list_(pa.struct({"doc_id": pa.int64(), "c": pa.int32(), "w": pa.binary()}))
    once, alone = once_and_row_by_row(lambda: _apart(80, 46), pa.record_batch([pa.array(x, kind) for x in zip(*rows, strict=True)], names=["opens", "others"]))
    assert once * 3 < alone


def test_pieces_of_windows_do_not_depend_on_their_neighbours():
    """Documents in which a hash comes again within a window's length give the same windows alone and among others."""
    r = random.Random(4)
    texts = [" ".join(r.choices([str(k) for k in range(n)], k=250)) for n in (2, 3, 9, 4000, 40, 4000, 1)]
    rows = [(i, t) for i, t in enumerate(texts)]
    of = lambda part: {x for b in _windows(4, 46)(iter([pa.record_batch({"doc_id": pa.array([i for i, _ in part], pa.int64()), "text": [t for _, t in part]})])) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert of(rows) == set().union(*(of([x]) for x in rows))


def test_packs_of_one_group_meet_in_several_tasks(spark, monkeypatch):
    def where(percent, t):
        def run(batches):
            from pyspark import TaskContext

            n = sum(b.num_rows for b in batches)
            if n:
                yield pa.record_batch({"doc_id": pa.array([TaskContext.get().partitionId()], pa.int64()), "other": pa.array([n], pa.int64()), "c": pa.array([0], pa.int32()), "pc": pa.array([0], pa.int32())})

        return run

    tasks = {}
    monkeypatch.setattr(substring_dedup, "_apart", where)
    monkeypatch.setattr(substring_dedup, "_verify", lambda held, pairs, percent, t: tasks.update({x.doc_id: x.other for x in pairs.collect()}))
    monkeypatch.setattr(substring_dedup, "PACK", (4, 16))
    r = np.random.default_rng(3)
    held = spark.createDataFrame([(i, r.integers(0, 1 << 32, 100, dtype=np.uint32).tobytes()) for i in range(300)], "doc_id long, w binary")
    left = spark.createDataFrame([(7, i, 50, False) for i in range(300)], "key long, doc_id long, c int, done boolean")
    for k, v in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}.items():
        spark.conf.set(k, v)
    try:
        substring_dedup._closing(left, held, 80, 46)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks.values()) > 1000 and max(tasks.values()) < 0.6 * sum(tasks.values())
