import random
from itertools import combinations

import numpy as np

from lexweave.llm.decontam import MASKS, decontaminate, find_overlaps, longest_run, masks_of


def corpus():
    r = random.Random(4)
    text = lambda n: ["".join(r.choices("abcdefghijkl", k=r.randrange(2, 8))) for _ in range(n)]
    items = {i: text(r.choice([7, 14, 30, 60])) for i in range(12)}
    docs, leaks = [], set()
    for d in range(80):
        w = text(r.randrange(1, 150))
        if d % 5 == 0:
            own = list(items[d % 12])
            if len(own) >= 30:
                for k in range(5, len(own), 11):
                    own[k] = "other"
            w = w[:20] + [x.upper() for x in own] + w[20:]
            leaks.add((d, d % 12))
        docs.append((d, " ".join(w)))
    return docs, [(i, " ".join(w)) for i, w in items.items()], leaks


def test_finds_substituted_passages_only(spark):
    docs, items, leaks = corpus()
    extra = [(900, None), (901, ""), (None, items[0][1]), (902, "a b c")]
    d = spark.createDataFrame([(a, b, "x", 0) for a, b in docs + extra], "doc_id long, text string, item string, w int")
    i = spark.createDataFrame(items + [(50, None), (51, ""), (52, "a b"), (None, docs[1][1])], "item_id long, text string")
    found = find_overlaps(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in found} == leaks
    sizes = {k: len(t.split()) for k, t in items}
    assert all(r.n_words >= min(13, sizes[r.item_id]) and r.n_matches * 5 >= r.n_words * 4 for r in found)
    kept = decontaminate(d, i)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {a for a, _ in docs + extra} - {a for a, _ in leaks}


def test_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert find_overlaps(d, i).count() == 0 and decontaminate(d, i).count() == 1
    assert find_overlaps(d.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_masks_meet_every_run_of_the_rule():
    # runs of up to 25 words decide, as of a longer one a half keeps the rule; longer ones of as many substitutions hold shorter ones
    for n, wrong in [(5, 1), (6, 1), (7, 1), (8, 1), (9, 1), (10, 2), (15, 3), (20, 4), (25, 5)]:
        left = np.array([sum(1 << k for k in places) for places in combinations(range(n), wrong)])
        for m in masks_of(n, list(MASKS)):
            for shift in range(n - len(m) + 1):
                left = left[left & int(m[::-1], 2) << shift != 0]
        assert not len(left), n


def test_longest_run_keeps_the_rule_and_misses_none():
    r = np.random.default_rng(3)
    for _ in range(300):
        n, least = int(r.integers(1, 40)), int(r.integers(1, 14))
        same = r.random(n) < 0.8
        ok = [j - i for i in range(n) for j in range(i + least, n + 1) if (~same[i:j]).sum() * 5 <= j - i]
        got = longest_run(same, np.ones(n, bool), least)
        assert (got is None) == (not ok)
        if got:
            s, k, hits = got
            assert least <= k <= max(ok) and hits == same[s : s + k].sum() and (k - hits) * 5 <= k


def test_changed_words_are_found_wherever_they_stand(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghijkl", k=8))
    items, docs, want = [], [], set()
    for n, wrong in [(5, 1), (7, 1), (9, 1), (12, 1), (12, 2), (15, 1), (15, 2), (18, 2), (19, 3), (30, 5)]:
        item = [word() for _ in range(n)]
        items.append((len(items), " ".join(item)))
        for places in r.sample(list(combinations(range(n), wrong)), min(n, 20)) if n < 30 else [r.sample(range(n), wrong) for _ in range(20)]:
            text = [word() if k in places else w for k, w in enumerate(item)]
            want.add((len(docs), items[-1][0]))
            docs.append((len(docs), " ".join([word() for _ in range(9)] + text + [word() for _ in range(9)])))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in find_overlaps(d, i).collect()} == want


def test_equals_brute_force(spark):
    import random

    import brute

    r = random.Random(8)
    word = lambda: f"w{r.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(r.choice((3, 5, 8, 12, 14, 20, 40))))) for k in range(25)]
    docs = []
    for d in range(120):
        own = [word() for _ in range(r.randrange(0, 60))]
        if d % 2:
            part = brute.words(items[r.randrange(25)][1])
            a = r.randrange(len(part))
            part = part[a : a + r.randrange(1, 30)]
            part = [w if r.random() > 0.15 else word() for w in part]
            k = r.randrange(len(own) + 1)
            own[k:k] = part
        docs.append((d, " ".join(own)))
    found = find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {(d, i) for d, t in docs for i, x in items if brute.overlaps(t, x)}
    assert {(x.doc_id, x.item_id) for x in found.collect()} == want and len(want) >= 10
