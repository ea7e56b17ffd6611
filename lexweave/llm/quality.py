"""Quality scores by positive-unlabelled learning.

Training minimises the non-negative PU risk (Kiryo et al., 2017) with a sigmoid
loss: ``pi * R+(P) + max(0, R-(U) - pi * R-(P))``, where P are trusted positives (label
1), U is web text without regard to labels and ``pi`` is the class prior, estimated from
the two samples: the least ratio of U to P above a score threshold, over thresholds
that keep enough positives. The model is a small network on bounded features
of the whole text: byte-class shares and transitions, word and line repetition, lengths.
The prior comes from networks that each saw only the other half of the rows.

The model is fitted on at most ``sample`` positives and ``sample`` unlabelled rows of
the training fold (lowest hashes of doc_id, so the same at any partitioning);
features are made where the text is read, so texts are never shuffled. All
documents are scored.

Null and empty texts have all-zero features and get a score like any other.
Null doc_id: scored, never learnt from. Rows that repeat a doc_id are scored one by
one. Labels other than 1 count as unlabelled. Without positives or unlabelled rows every
score is 0.5. An empty table gives no rows. Only doc_id, text and the label are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import drawn, hash_words, table, text_slices

CLASSES = 9
SAMPLE = 12_000
SLICE = 1 << 18  # bytes of text whose features are made at once, in arrays of 8 bytes for each of them


def _byte_classes() -> np.ndarray:
    c = np.full(256, 7)
    c[97:123], c[65:91], c[48:58], c[[9, 11, 12, 13, 32]], c[10] = 0, 1, 2, 3, 4
    c[[33, 44, 46, 59, 63]] = 5
    c[[58, 39, 45, 40, 41, 34]] = 6
    c[128:] = 8
    return c.astype(np.uint8)


def text_features(texts: list[str]) -> np.ndarray:
    """One row of features per text, over the whole of it."""
    classes = _byte_classes()
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw])
    data = classes[np.frombuffer(b"".join(raw), np.uint8)]
    doc = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
    share = np.bincount(doc * CLASSES + data, minlength=len(raw) * CLASSES).reshape(len(raw), CLASSES)
    same = doc[1:] == doc[:-1]
    step = np.bincount((doc[1:] * CLASSES + data[:-1])[same] * CLASSES + data[1:][same], minlength=len(raw) * CLASSES**2).reshape(len(raw), -1)
    words, first = hash_words(texts)
    extra = np.zeros((len(raw), 9))
    for i, t in enumerate(texts):
        w = words[first[i] : first[i + 1]]
        n = len(w)
        if not n:
            continue
        s = np.sort(w)
        edges = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
        counts = np.diff(edges)
        pairs = np.unique(w[1:] * np.uint64(0x9E3779B97F4A7C15) + w[:-1]) if n > 1 else w
        lines = t.split("\n")
        extra[i] = (np.log1p(n) / 10, len(counts) / n, counts.max() / n, (counts == 1).sum() / n, len(pairs) / max(1, n - 1), (w[1:] == w[:-1]).mean() if n > 1 else 0, len(set(lines)) / len(lines), np.log1p(len(lines)) / 10, np.log1p(sizes[i] / n))
    total = np.maximum(sizes, 1)[:, None]
    return np.hstack((np.sqrt(share / total), np.sqrt(step / total), extra)).astype(np.float32)


class Network:
    """Standardised inputs, one hidden layer of tanh units, one output."""

    def __init__(self, x: np.ndarray, hidden: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), 1 / (x.std(0) + np.float32(1e-3))
        d = x.shape[1]
        self.w = [w.astype(np.float32) for w in (r.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), np.zeros(1))]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -6, 6)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.w[0] + self.w[1])
        return h, h @ self.w[2] + self.w[3][0]

    def gradient(self, z: np.ndarray, h: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        back = np.outer(d, self.w[2]) * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ d, np.array([d.sum()])]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(self.inputs(x))[1], -30, 30)))


def _adam(net: Network, steps: int, batch: int, rate: float, gradient, decay: float = 1e-4) -> None:
    m, v = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w]
    for t in range(1, steps + 1):
        for k, g in enumerate(gradient(t, batch)):
            g = g + decay * net.w[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            net.w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def estimate_prior(p: np.ndarray, u: np.ndarray, least: float = 0.5) -> float:
    """Share of positives in U: the least ratio of tail shares over thresholds that keep ``least`` of P, with a margin for noise."""
    cuts = np.quantile(p, np.linspace(0, 1 - least, 60))
    tp, tu = np.array([(p >= c).mean() for c in cuts]), np.array([(u >= c).mean() for c in cuts])
    ratio = tu / tp
    margin = ratio * np.sqrt((1 - tp) / (tp * len(p)) + (1 - tu) / (np.maximum(tu, 1e-9) * len(u)))
    return float(np.clip((ratio + margin).min(), 0.01, 0.99))


def fit_pu(p: np.ndarray, u: np.ndarray, pf: np.ndarray, uf: np.ndarray, *, hidden: int = 16, steps: int = 1200, batch: int = 256, rate: float = 0.005, seed: int = 11) -> tuple[Network, float]:
    """Network and prior from features of positives and of unlabelled rows; ``pf``, ``uf``: each row's half, for the prior."""
    draw = np.random.default_rng(seed)

    def separated(a: np.ndarray, b: np.ndarray) -> Network:  # positives against unlabelled
        net = Network(np.vstack((a, b)), hidden)
        za, zb = net.inputs(a), net.inputs(b)

        def gradient(_: int, n: int) -> list[np.ndarray]:
            z = np.vstack((za[draw.integers(0, len(za), n)], zb[draw.integers(0, len(zb), n)]))
            h, f = net.forward(z)
            return net.gradient(z, h, (1 / (1 + np.exp(-f)) - np.repeat([1.0, 0.0], n)) / (2 * n))

        _adam(net, min(steps // 3, 4 + (len(a) + len(b)) // 16), batch, rate, gradient, 1e-3)
        return net

    halves = [(p[pf == k], u[uf == k]) for k in (0, 1)]
    if all(len(x) for half in halves for x in half):
        nets = [separated(*half) for half in halves]
        prior = estimate_prior(np.concatenate([nets[1 - k].scores(halves[k][0]) for k in (0, 1)]), np.concatenate([nets[1 - k].scores(halves[k][1]) for k in (0, 1)]))
    else:
        prior = 0.5
    net = Network(np.vstack((p, u)), hidden)
    zp, zu = net.inputs(p), net.inputs(u)

    def risk(_: int, n: int) -> list[np.ndarray]:
        a, b = zp[draw.integers(0, len(zp), n)], zu[draw.integers(0, len(zu), n)]
        ha, fa = net.forward(a)
        hb, fb = net.forward(b)
        sa, sb = 1 / (1 + np.exp(-fa)), 1 / (1 + np.exp(-fb))  # loss of a positive: 1 - s; of a negative: s
        negative = sb.mean() - prior * sa.mean()
        da, db = sa * (1 - sa) / n, sb * (1 - sb) / n
        if negative >= 0:
            return [x + y for x, y in zip(net.gradient(a, ha, -2 * prior * da), net.gradient(b, hb, db), strict=True)]
        return [x + y for x, y in zip(net.gradient(a, ha, prior * da), net.gradient(b, hb, -db), strict=True)]  # back out of the negative part

    _adam(net, steps, batch, rate, risk)
    return net, prior


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_slices(batches, "text", SLICE):
        rows = text_features(texts)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(rows), pa.list_(pa.float32()))], names=["doc_id", "x"])


def fold(column: str, parts: int) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, parts: int = 3, held: int = 1) -> tuple[Network | None, float]:
    """Fit on the training fold of ``docs(doc_id, text)`` and ``labels(doc_id, label)``.

    Ids are chosen before any text is read, so features are made for the sample alone.
    """
    in_fold = lambda df: df.where("doc_id is not null").where(fold("doc_id", parts) != held)
    draw = lambda df: drawn(df.distinct(), "doc_id", sample, 5)
    marked = in_fold(labels.where("label = 1").select("doc_id"))
    p = draw(marked.join(docs.select("doc_id"), "doc_id", "left_semi")).withColumn("kind", F.lit(1))
    u = draw(in_fold(docs.select("doc_id"))).withColumn("kind", F.lit(0))
    chosen = [(r["doc_id"], r["kind"]) for r in p.unionByName(u).collect()]  # at most twice `sample` ids
    ids = pa.array(np.unique(np.array([d for d, _ in chosen], np.int64)))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        return _features(b.filter(pc.is_in(b.column(0), ids)) for b in batches)

    made = docs.select("doc_id", "text").mapInArrow(picked, "doc_id long, x array<float>").groupBy("doc_id").agg(F.min("x").alias("x")).toArrow()  # a bounded sample: one row for each id
    by_id = dict(zip(made["doc_id"].to_pylist(), made["x"].to_pylist(), strict=True))
    kept = [[d for d, k in sorted(chosen) if k == kind and d in by_id] for kind in (1, 0)]
    if not all(kept):
        return None, 0.5
    (xp, xu), (pf, uf) = ([np.array([by_id[d] for d in ids], np.float32) for ids in kept], [np.array(ids) // parts % 2 for ids in kept])
    return fit_pu(xp, xu, pf, uf)


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, score) for every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text", SLICE):
            s = net.scores(text_features(texts)) if net else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.astype(np.float64))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **kwargs) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    docs = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    labels = labels.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{label_col}` as label")
    net, _ = train(docs, labels, **kwargs)
    held = fold("doc_id", kwargs.get("parts", 3)) == kwargs.get("held", 1)
    return score(docs, net).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **kwargs) -> DataFrame:
    """The rows of ``docs`` that are predicted good; columns as they are, whatever their names.

    Each row is judged by its own text, null texts as empty ones; rows without an id and rows that repeat an id are
    judged like others. Texts aren't shuffled. With nothing to learn from every row scores 0.5 and stays.
    """
    net, _ = train(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), labels.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{label_col}` as label"), **kwargs)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:  # as it comes: neither it nor its texts are copied whole
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        scores = [net.scores(text_features(t)) if net else np.full(len(t), 0.5) for _, t in text_slices([batch], "text", SLICE)]
        return pa.array(np.concatenate([np.zeros(0), *scores]) >= 0.5)

    return docs.where(good(F.col(text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
