import math
import random
import re
from collections import Counter

from lexweave.llm.lexical import rank

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, rank int, h string, tier int, n string, score string", "item_id long, text string, doc_id long"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for i, t in items:
        if i is not None and terms(t):
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in wanted.items():
        scores = []
        for d, c in held:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **kwargs):
    d = spark.createDataFrame([(i, t, 0, "", 0, "", "") for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    rows = rank(d, q, **kwargs).collect()
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows), key=str)


def test_every_tier_gives_the_scores_of_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    pick = lambda n: " ".join(words[min(int(r.expovariate(0.03)), 199)] for _ in range(n))
    docs = [(i, pick(r.randint(1, 60))) for i in range(400)] + [(500 + i, "Rare w1 w2") for i in range(60)]
    items = [(i, pick(r.randint(1, 12))) for i in range(12)] + [(20, "rare"), (21, "w1 w2 w3"), (22, "absent")]
    want = brute(docs, items, 10)
    decided = []
    for tiers in ((2, 8), (8, 64), (64, 1000)):
        seen = []
        assert run(spark, docs, items, k=10, tiers=tiers, report=seen) == want
        decided.append([sum(x) for x in zip(*seen, strict=True)])
    assert decided[0][2] > 0 and decided[2][0] > 0  # some fall through to all rows, some are proven at once


def test_odd_rows(spark):
    long = " ".join(["alpha"] + [f"x{i}" for i in range(30_000)] + ["beta", "alpha"])
    docs = [(1, None), (2, ""), (3, "-- !"), (4, "Alpha_beta"), (5, "ÄLPHA alpha"), (5, "ÄLPHA alpha"), (None, "alpha"), (None, "gamma beta"), (7, long), (8, "other words here")]
    items = [(1, "alpha, BETA"), (1, "gamma"), (None, "alpha"), (2, None), (3, "?"), (4, "Älpha ÄLPHA"), (5, " ".join(f"x{i}" for i in range(0, 30_000, 2)))]
    assert run(spark, docs, items, k=4) == brute(docs, items, 4)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []


def test_items_in_several_blocks(spark, monkeypatch):
    import lexweave.llm.lexical as module

    monkeypatch.setattr(module, "BLOCK_ITEMS", 3)
    docs = [(i, f"t{i % 7} t{i % 5} t{i % 3}") for i in range(40)]
    items = [(i, f"t{i} t{i + 1}") for i in range(8)]
    assert run(spark, docs, items, k=5) == brute(docs, items, 5)
