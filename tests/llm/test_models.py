"""Quality classifier and language model: held-out figures and exact parts."""

import math
import time
import zlib
from collections import Counter

import brute
import numpy as np

from lexweave.llm.lm_scoring import Lookup, history, scored_documents, token_scores, train
from lexweave.llm.quality import quality_scores

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_scores(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in out.doc_id]).all()
    assert (out.predicted == (out.score >= 0.5)).all()
    both = out.merge(labels.toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.93
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.98


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (2, "", 0.1), (None, "a b", 0.2)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_scores(docs, none).collect()
    assert len(out) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in out)
    assert quality_scores(docs.limit(0), none).count() == 0


def test_language_model_against_plain_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9002, "  "), (9003, "unseenword zzzz")], docs.schema))
    rows = docs.collect()
    tokens = {r.doc_id: [*brute.words(r.text), None] for r in rows}
    train = [d for d in tokens if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(t for d in train for t in tokens[d])
    n, v = sum(counts.values()), len(counts)
    better = base_sum = n_held = 0.0
    for r in scored_documents(docs.withColumn("h", docs.doc_id)).collect():
        own = tokens[r.doc_id]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[t] > 0 for t in own), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.held_out == (r.doc_id not in train)
        if r.held_out:
            better, base_sum, n_held = better + r.score, base_sum + r.base_score, n_held + r.n_tokens
    assert better > base_sum + 0.1 * n_held  # log10 per token


def test_model_is_a_distribution(spark):
    """After any history the probabilities of all known words, the end and one unknown word add up to 1."""
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in r.zipf(1.3, 40) % 300) for _ in range(60)]
    model, _ = train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    words = Lookup(model.keys)
    vocabulary = sorted({w for t in texts for w in t.split()})
    for before in ("", "w1 ", "w2 w1 ", "w7 never "):
        total, at = 0.0, len(before.split())
        for text in [before, *[before + w for w in [*vocabulary, "unseen"]]]:
            index, cls, leaf, rows, _ = history([text], words, model)
            total += 10 ** token_scores(model, cls, leaf, rows)[at] * (model.counts[index[at]] + 1 if index[at] >= 0 else 1)
        assert abs(total - 1) < 1e-4, before


def test_history_moves_words_within_a_class(spark):
    """x follows a and y follows b, though both are as frequent."""
    texts = ["a x c b y c " * 20, "b y d a x d " * 20] * 20
    model, _ = train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    words = Lookup(model.keys)

    def p(text):
        index, cls, leaf, rows, _ = history([text], words, model)
        return token_scores(model, cls, leaf, rows)[-2] + np.log10(model.counts[index[-2]] + 1)

    assert p("c a x") > p("c b x") + 0.5 and p("c b y") > p("c a y") + 0.5


def test_lookup():
    keys = np.unique(np.random.default_rng(0).integers(1, 2**63, 5000).astype(np.uint64))
    found = Lookup(keys).find(np.concatenate((keys, keys + np.uint64(1))))
    assert (found[: len(keys)] == np.arange(len(keys))).all() and (found[len(keys) :] < 0).all()


def test_empty_table(spark):
    assert scored_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_training_step_sums_rows_quickly():
    from lexweave.llm.lm_scoring import Learner, row_sums

    r = np.random.default_rng(3)
    rows = (r.zipf(1.3, (4096, 4)) % 20_000).astype(np.int32)  # a few rows are met by hundreds of tokens
    g = r.normal(size=(4096, 41)).astype(np.float32)
    at, counts, sums = row_sums(g, rows.T.ravel())
    plain = np.zeros((20_000, 41))
    for k in range(4):
        np.add.at(plain, rows[:, k], g)
    assert (at == np.unique(rows)).all() and (counts == np.unique(rows, return_counts=True)[1]).all()
    assert np.abs(sums - plain[at]).max() < 1e-3

    def sorted_sums():  # of the sorted rows, as one reduction
        flat = rows.T.ravel()
        order = np.argsort(flat, kind="stable")
        return np.add.reduceat(g[order % len(g)], np.flatnonzero(np.diff(flat[order], prepend=-1)), axis=0)

    def least(run, n=7):
        times = []
        for _ in range(n):
            began = time.process_time()
            run()
            times.append(time.process_time() - began)
        return min(times)

    learner, y = Learner(np.zeros((20_000, 41), np.float32), np.zeros(41, np.float32), 0.3), r.integers(0, 41, 4096)
    assert least(lambda: learner.step(rows, y)) < 1.5 * least(sorted_sums)


def test_texts_are_judged_in_small_slices(spark):
    from lexweave.llm import quality

    assert quality._byte_classes().itemsize == 1 and quality.SLICE <= 1 << 18
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.keep_good(docs, labels)
    good = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == good
