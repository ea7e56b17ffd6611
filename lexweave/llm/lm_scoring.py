"""Hashed maximum-entropy language model with a class-factored softmax of two levels.

P(word | history) = P(class | history) * P(leaf | class, history) * P(word | leaf). Both softmaxes are
log-linear in hashed features of the history: the previous word, the previous two, the word two
back (a skip), and the classes of the two previous words. Words are clustered by what stands before them
(their counts after the ``ANCHORS`` commonest words); in the order of clusters and frequency, ``CLASSES`` classes and in each
``LEAVES`` leaves have about the same share of the tokens, so the commonest words have a leaf of their own. Rarer
words form a tail class for each cluster, and those that aren't counted in the tasks' table, unknown ones included,
another. Within a leaf or tail a word has its add-one share.

Everything is learnt from all training documents. Word counts are made by partial sums in tasks, then a
shuffle. Weights are trained in ``rounds``, each over its share of the documents:
every task runs AdaGrad on small batches from the common weights and sends the rows that it
changed; they are averaged by how often a task met each feature, in two steps, so that few rows meet in a task.
The hashed tables grow with the square root of the number of words, from 2^12 rows to 2^``MOST_BITS``. Scoring works on sparse numpy batches. Sent to all
tasks are only the weights, a table of the ``COUNTED`` commonest words (16 bytes each) and their
classes, all of bounded size; counts of rarer words come by a join on their hash.

Words are hashed to 64 bits. Null text is empty: just the end token. Null doc_id: scored, not learnt from. Repeated
rows count and are scored one by one. An empty table gives no rows; with no
training tokens every word is unknown. Very long texts are one batch of tokens each. Only doc_id and text are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import hash_words, materialize, mix64, release, table, text_slices, top_counts

END, START = np.uint64(0x3C6EF372FE94F82B), np.uint64(0xA54FF53A5F1D36F1)
ANCHORS = 64
CLASSED = 1 << 16
COUNTED = 1 << 19
GROUPS = 8
CLASSES = 32
LEAVES = 32
MOST_BITS = 18
BLOCK = 2_000_000
ROWS = 1 << 11  # feature rows in a block of weights


class Lookup:
    """Index of 64-bit keys by open addressing, for whole arrays at a time; -1 if absent."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 1)
        self.mask = np.uint64((1 << self.bits) - 1)
        self.at = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.append(keys, np.uint64(0))
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            slot = ((keys[todo] >> np.uint64(7)) + np.uint64(step) & self.mask).astype(np.int64)
            free = self.at[slot] < 0
            self.at[slot[free][::-1]] = todo[free][::-1]  # of several the first stays
            todo, step = todo[self.at[slot] != todo], step + 1

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        todo, step = np.arange(len(h)), 0
        while len(todo):
            got = self.at[((h[todo] >> np.uint64(7)) + np.uint64(step) & self.mask).astype(np.int64)]
            same = self.keys[got] == h[todo]
            same &= got >= 0
            out[todo[same]] = got[same]
            todo, step = todo[(got >= 0) & ~same], step + 1
        return out


def token_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts with an end token each, their two predecessors, and each text's first index."""
    words, first = hash_words(texts)
    counts = np.diff(first)
    begin = first + np.arange(len(first))
    out = np.empty(len(words) + len(texts), np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(texts)), counts)] = words
    out[begin[1:] - 1] = END
    one, two = np.empty_like(out), np.empty_like(out)
    one[1:], two[2:] = out[:-1], out[:-2]
    one[begin[:-1]] = two[begin[:-1]] = START
    second = begin[:-1][counts > 0] + 1
    two[second] = START
    return out, one, two, begin


def feature_rows(one: np.ndarray, two: np.ndarray, c1: np.ndarray, c2: np.ndarray, bits: int) -> np.ndarray:
    """Weight rows of the features of each token's history (n x 4)."""
    shift = np.uint64(64 - bits)
    classes = (c1.astype(np.uint64) << np.uint64(8) | c2.astype(np.uint64)) + np.uint64(0x510E527FADE682D1)
    a = mix64(one + np.uint64(0x1F83D9ABFB41BD6B)) >> shift
    b = mix64(one * np.uint64(0x5BE0CD19137E2179) + two) >> shift
    c = mix64(two + np.uint64(0x9B05688C2B3E6C1F)) >> shift
    return np.stack((a, b, c, mix64(classes) >> shift), 1).astype(np.int32)


def leaf_rows(rows: np.ndarray, cls: np.ndarray, bits: int) -> np.ndarray:
    """Rows of the second level: the previous word and the classes, within a class (n x 2)."""
    own = rows[:, [0, 3]].astype(np.uint64) << np.uint64(8) | cls[:, None].astype(np.uint64)
    return (mix64(own) >> np.uint64(64 - bits)).astype(np.int32)


def count_words(docs: DataFrame) -> DataFrame:
    """(h, c) over all rows of ``docs(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

        for _, texts in text_slices(batches, "text"):
            held.append(token_rows(texts)[0])
            if sum(map(len, held)) >= BLOCK:
                yield flush()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _cells(docs: DataFrame, size: int, count) -> np.ndarray:
    """Sums of ``count(tokens, one, two)``, arrays of cells below ``size``, over ``docs(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int32)
        for _, texts in text_slices(batches, "text"):
            tokens, one, two, _ = token_rows(texts)
            for cell in count(tokens, one, two):
                cells, n = np.unique(cell, return_counts=True)
                seen[cells] += n.astype(np.int32)
        on = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(seen[on].astype(np.int64))], names=["cell", "n"])

    sums = docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most `size` rows
    out = np.zeros(size)
    out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return out


def _groups(docs: DataFrame, keys: np.ndarray) -> np.ndarray:
    """Cluster of each key: frequent words by the anchors before them, the others by the clusters of the words before them."""
    if not len(keys):
        return np.zeros(0, np.int64)
    n = min(CLASSED, len(keys))
    words, anchors = Lookup(keys[:n]), Lookup(keys[:ANCHORS])

    def after_anchors(tokens: np.ndarray, one: np.ndarray, two: np.ndarray) -> Iterator[np.ndarray]:
        w = words.find(tokens)
        for before in (one, two):
            a = anchors.find(before)
            on = (a >= 0) & (w >= 0)
            yield w[on].astype(np.int64) * ANCHORS + a[on]

    group = _cluster(_cells(docs, n * ANCHORS, after_anchors).reshape(-1, ANCHORS), GROUPS)
    if n == len(keys):
        return group
    rare = Lookup(keys[n:])

    def after_groups(tokens: np.ndarray, one: np.ndarray, two: np.ndarray) -> Iterator[np.ndarray]:
        w = rare.find(tokens)
        on = np.flatnonzero(w >= 0)
        for before in (one, two):
            g = words.find(before[on])
            yield w[on][g >= 0].astype(np.int64) * GROUPS + group[g[g >= 0]]

    return np.concatenate((group, _cells(docs, (len(keys) - n) * GROUPS, after_groups).reshape(-1, GROUPS).argmax(1)))


def _cluster(x: np.ndarray, groups: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    """k-means over rows scaled to unit length; rows without counts go to group 0."""
    x = np.sqrt(x)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    r = np.random.default_rng(seed)
    centres = x[:1]
    for _ in range(groups - 1):  # far apart from each other, among the frequent words
        far = 1 - (x[:4096] @ centres.T).max(1)
        centres = np.vstack((centres, x[r.choice(len(far), p=far**2 / (far**2).sum()) if far.sum() > 1e-9 else 0]))
    for _ in range(rounds):
        group = (x @ centres.T).argmax(1)
        centres = np.stack([x[group == g].sum(0) if (group == g).any() else centres[g] for g in range(groups)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return (x @ centres.T).argmax(1)


def _even(mass: np.ndarray, parts: int) -> np.ndarray:
    """Neighbours in ``parts`` runs of about the same mass."""
    before = np.cumsum(mass) - mass / 2
    return np.minimum((before / max(mass.sum(), 1e-9) * parts).astype(np.int64), parts - 1)


class Model:
    """Counts, classes and leaves of the commonest words, totals, and the weights of both softmaxes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, groups: np.ndarray, tokens: int, distinct: int):
        self.keys, self.counts = keys, counts  # in falling order of counts
        self.tokens, self.distinct = tokens, distinct
        self.bits = int(np.clip(round(np.log2(max(distinct, 1)) / 2) + 6, 12, MOST_BITS))
        self.n_classes = CLASSES + GROUPS + 1
        self.classes, self.leaves = CLASSES + groups, np.zeros(len(keys), np.int64)
        order = np.argsort(groups[:CLASSED], kind="stable")  # by cluster, then frequency
        mass = counts[order].astype(float)
        self.classes[order] = _even(mass, CLASSES)
        for c in range(CLASSES):
            own = order[self.classes[order] == c]
            self.leaves[own] = _even(counts[own].astype(float), LEAVES)
        share = np.zeros((self.n_classes, LEAVES))
        np.add.at(share, (self.classes, self.leaves), counts + 1)
        share[-1, 0] = tokens - counts.sum() + distinct - len(keys) + 1  # one more for what is unknown
        self.log_share = np.log10(np.maximum(share, 1))
        within = lambda x: np.where(x > 0, np.log(np.maximum(x, 1) / np.maximum(x.sum(-1, keepdims=True), 1)), -30).astype(np.float32)  # noqa: E731  no chance for what holds no word
        self.bias, self.leaf_bias = within(share.sum(1)), within(share[:CLASSES])
        self.weights = np.zeros((1 << self.bits, self.n_classes), np.float32)
        self.leaf_weights = np.zeros((1 << self.bits, LEAVES), np.float32)

    def place(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and leaf of the words with this index among the keys (-1: not there)."""
        cls, leaf = np.full(len(index), self.n_classes - 1, np.int64), np.zeros(len(index), np.int64)
        own = index >= 0
        cls[own], leaf[own] = self.classes[index[own]], self.leaves[index[own]]
        return cls, leaf


def history(texts: list[str], words: Lookup, model: Model) -> tuple:
    """Tokens, their index, class, leaf, rows of their features, and each text's first token."""
    tokens, one, two, begin = token_rows(texts)
    index = words.find(tokens)
    cls, leaf = model.place(index)
    start = model.n_classes
    c1, c2 = np.full(len(cls), start), np.full(len(cls), start)
    c1[1:], c2[2:] = cls[:-1], cls[:-2]
    c1[begin[:-1]] = c2[begin[:-1]] = start
    second = begin[:-1][np.diff(begin) > 1] + 1
    c2[second] = start
    return index, cls, leaf, feature_rows(one, two, c1, c2, model.bits), begin


def logits(w: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    f = w.take(rows[:, 0], 0)
    for k in range(1, rows.shape[1]):
        f += w.take(rows[:, k], 0)
    f += bias
    return f


def softmax(f: np.ndarray) -> np.ndarray:
    """In place."""
    f -= f.max(1, keepdims=True)
    np.exp(f, out=f)
    f /= f.sum(1, keepdims=True)
    return f


def log_share(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The logarithm of softmax(f) at ``y``; ``f`` is spent."""
    f -= f.max(1, keepdims=True)
    own = f[np.arange(len(y)), y]
    np.exp(f, out=f)
    return own - np.log(f.sum(1))


def put_rows(w: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """w[at] = rows, each row as one item, which is several times faster."""
    item = np.dtype((np.void, w.shape[1] * w.itemsize))
    w.view(item).ravel()[at] = rows.view(item).ravel()


def row_sums(g: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of ``flat``, how often each is there, and for each the sum of the rows of ``g`` where it stands; place i of
    ``flat`` has row i % len(g).

    Second occurrences are added for all values at once, then third ones, until few values are left.
    """
    mixed = np.sort(flat.astype(np.int64) << 32 | np.arange(len(flat)))
    value, row = mixed >> 32, (mixed & 0xFFFFFFFF) % len(g)
    edges = np.flatnonzero(np.diff(value, prepend=-1))
    counts = np.diff(np.append(edges, len(flat)))
    out = g.take(row[edges], 0)
    k, more = 1, np.flatnonzero(counts > 1)
    while len(more) > 64:
        put_rows(out, more, out.take(more, 0) + g.take(row[edges[more] + k], 0))
        k += 1
        more = more[counts[more] > k]
    for i in more.tolist():
        out[i] += g.take(row[edges[i] + k : edges[i] + counts[i]], 0).sum(0)
    return value[edges], counts, out


class Learner:
    """AdaGrad on one weight table, from common weights; remembers which rows it met and how often."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, rate: float):
        self.w, self.b, self.rate = weights.copy(), bias.copy(), rate
        self.power, self.bias_power = np.ones_like(self.w), np.ones_like(self.b)
        self.visits = np.zeros(len(self.w), np.float32)

    def step(self, rows: np.ndarray, y: np.ndarray, cls: np.ndarray | None = None) -> None:
        g = softmax(logits(self.w, rows, self.b if cls is None else self.b.take(cls, 0)))
        g[np.arange(len(y)), y] -= 1
        at, counts, change = row_sums(g, rows.T.ravel())
        self.visits[at] += counts
        power = self.power.take(at, 0)
        power += change * change
        put_rows(self.power, at, power)
        np.sqrt(power, out=power)
        change *= self.rate
        change /= power
        put_rows(self.w, at, self.w.take(at, 0) - change)
        own = g.sum(0) if cls is None else np.zeros_like(self.b)
        if cls is not None:
            np.add.at(own, cls, g)
        self.bias_power += own * own
        self.b -= self.rate * own / np.sqrt(self.bias_power)


def _train_round(docs: DataFrame, model: Model, rate: float, batch: int) -> None:
    """One round over ``docs(text)``: the model's weights become the average of what the tasks make of them."""
    start = model
    names, schema = ["level", "block", "step", "rows", "w", "visits"], "level int, block int, step int, rows binary, w binary, visits binary"

    def packed(level: int, block: int, step: int, rows: np.ndarray, mean: np.ndarray, visits: np.ndarray) -> pa.RecordBatch:
        ints = [pa.array([x], pa.int32()) for x in (level, block, step)]
        kinds = ((rows, np.int32), (mean, np.float16), (visits, np.float32))  # changes are small, so half of the bits do
        return pa.RecordBatch.from_arrays([*ints, *[pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in kinds]], names=names)

    def unpacked(rows: bytes, w: bytes, visits: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.frombuffer(rows, np.int32)
        return rows, np.frombuffer(w, np.float16).reshape(len(rows), -1).astype(np.float64), np.frombuffer(visits, np.float32).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, step = Lookup(start.keys), TaskContext.get().partitionId() % steps
        one, two = Learner(start.weights, start.bias, rate), Learner(start.leaf_weights, start.leaf_bias, rate)
        n, leafed = 0, np.zeros(CLASSES)
        for _, texts in text_slices(batches, "text"):
            _, cls, leaf, rows, _ = history(texts, words, start)
            for a in range(0, len(cls), batch):
                r, c = rows[a : a + batch], cls[a : a + batch]
                one.step(r, c)
                on = np.flatnonzero(c < CLASSES)
                if len(on):
                    two.step(leaf_rows(r[on], c[on], start.bits), leaf[a + on], c[on])
                    leafed += np.bincount(c[on], minlength=CLASSES)
            n += len(cls)
        if not n:
            return
        for level, own, w in ((1, one, start.weights), (2, two, start.leaf_weights)):
            met = np.flatnonzero(own.visits)  # only rows that this task met
            for b in np.unique(met // ROWS):
                at = met[met // ROWS == b]
                yield packed(level, int(b), step, at, own.w[at] - w[at], own.visits[at])
        yield packed(3, 0, step, np.zeros(1), one.b - start.bias, np.array([n]))
        yield packed(4, 0, step, np.arange(CLASSES), two.b - start.leaf_bias, leafed)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[np.ndarray]] = {}  # a bounded number of blocks of bounded size
        for b in batches:
            for level, block, *raw in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4, 5)), strict=True):
                rows, w, visits = unpacked(*raw)
                total = sums.setdefault((level, block), [np.zeros((ROWS, w.shape[1])), np.zeros(ROWS)])
                total[0][rows % ROWS] += w * visits[:, None]
                total[1][rows % ROWS] += visits
        for (level, block), (total, visits) in sums.items():
            at = np.flatnonzero(visits)
            yield packed(level, block, 0, at + block * ROWS, total[at] / visits[at, None], visits[at])

    docs = docs.select("text")
    steps = int(np.ceil(np.sqrt(docs.rdd.getNumPartitions())))  # sums of a block before the last
    parts = docs.mapInArrow(run, schema).repartition("level", "block", "step").mapInArrow(mean, schema)
    made = materialize(parts.repartition("level", "block").mapInArrow(mean, schema))
    for r in made.collect():  # the weights, of bounded size
        rows, change, _ = unpacked(r["rows"], r["w"], r["visits"])
        if r["level"] == 3:
            model.bias = model.bias + change[0].astype(np.float32)
        else:
            {1: model.weights, 2: model.leaf_weights, 4: model.leaf_bias}[r["level"]][rows] += change
    release(made)


def train(docs: DataFrame, *, rounds: int = 2, rate: float = 0.3, batch: int = 4096) -> tuple[Model, DataFrame]:
    """Model and (h, c) counts, from all rows of ``docs(doc_id, text)``."""
    counts = materialize(count_words(docs))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = top_counts(counts, COUNTED)  # at most COUNTED rows of 16 bytes
    keys, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    model = Model(keys, c, _groups(docs, keys), total["n"] or 0, total["v"])
    for k in range(rounds):
        _train_round(docs.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(rounds)) == k), model, rate, batch)
    return model, counts


def token_scores(model: Model, cls: np.ndarray, leaf: np.ndarray, rows: np.ndarray, batch: int = 4096) -> np.ndarray:
    """log10 of P(class | history) P(leaf | class, history) over the leaf's total; a word's count plus one goes on top."""
    out = np.empty(len(cls))
    for a in range(0, len(cls), batch):
        r, c, s = rows[a : a + batch], cls[a : a + batch], leaf[a : a + batch]
        p = log_share(logits(model.weights, r, model.bias), c)
        on = np.flatnonzero(c < CLASSES)
        p[on] += log_share(logits(model.leaf_weights, leaf_rows(r[on], c[on], model.bits), model.leaf_bias.take(c[on], 0)), s[on])
        out[a : a + batch] = p / np.log(10) - model.log_share[c, s]
    return out


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base, score) for every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row = Lookup(model.keys), TaskContext.get().partitionId() << 40
        log_count = np.log10(model.counts + 1.0)
        for part, texts in text_slices(batches, "text"):
            tokens = token_rows(texts)[0]
            index, cls, leaf, rows, begin = history(texts, words, model)
            log_p = token_scores(model, cls, leaf, rows)
            there = index >= 0
            own = np.where(there, log_count[index], 0.0) if len(log_count) else np.zeros(len(tokens))
            sums = lambda x, b=begin: np.add.reduceat(x, b[:-1])  # noqa: E731  every text has its end token
            rest = []
            for i in range(len(texts)):
                h, n = np.unique(tokens[begin[i] : begin[i + 1]][~there[begin[i] : begin[i + 1]]], return_counts=True)
                rest.append([{"h": a, "n": b} for a, b in zip(h.view(np.int64).tolist(), n.tolist(), strict=True)])
            columns = [pa.array(row + np.arange(len(texts))), part.column(0), pa.array(np.diff(begin)), pa.array(sums(there.astype(np.int64))), pa.array(sums(own)), pa.array(sums(log_p)), pa.array(rest, pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())])))]
            row += len(texts)
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_tokens", "known", "logs", "log_p", "rest"])

    schema = "row long, doc_id long, n_tokens long, known long, logs double, log_p double, rest array<struct<h:long,n:int>>"
    made = materialize(docs.select("doc_id", "text").mapInArrow(run, schema))
    rare = made.select("row", F.explode("rest").alias("x")).select("row", "x.h", "x.n").join(counts, "h")
    rare = rare.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare"))
    joined = made.drop("rest").join(rare, "row", "left")
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("rare", F.lit(0.0))
    base = F.col("logs") + logs - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + model.distinct + 1)))
    return joined.select("doc_id", "n_tokens", (F.col("known") + more).alias("n_known"), base.alias("base_score"), (F.col("log_p") + F.col("logs") + logs).alias("score"))


def scored_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, held: int = 2, **kwargs) -> DataFrame:
    """Train on the training fold of ``docs`` and score every row."""
    docs = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts
    model, counts = train(docs.where(fold != held), **kwargs)
    out = score(docs, model, counts)
    return out.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(table(spark, sf_dir, "documents"))
