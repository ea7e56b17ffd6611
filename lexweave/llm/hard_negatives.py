"""Hard-negative mining over vantage-point trees.

A score is the integer inner product of two vectors whose components are ``floor(scale * x)``. Every vector gets one more component,
``sqrt(R^2 - |x|^2)`` with R the greatest norm, and an anchor's is 0 there: then the squared distance is
``|anchor|^2 + R^2 - 2 score``. Higher scores are nearer, and a window of scores is an annulus around the anchor.

1. A tree of vantage points, built from a sample of at most ``sample`` vectors, parts space into at most ``regions`` regions. Each
   vector goes to its region; a region's vectors are dealt by hash into blocks of about ``block``, so a region with a third of all vectors is
   many blocks. Each block gets a vantage-point tree of its own, halved by distance, with leaves of ``leaf`` vectors.
2. For a search, the tree's splits bound an anchor's distance to each region. The regions that meet its annulus and may be nearest
   are visited first; the k-th score found there bounds the others, and only regions and leaves that can be nearer are visited after them.
3. In a block the leaves of each anchor come nearest first by their bounds, within its annulus, until the next
   leaf can't hold a better row. Rows of a leaf are scored exactly, on integers.

Positives are the first same-label rows (an annulus without bounds), negatives the first different-label rows of each window
``percent * positive <= 100 * negative <= 100 * positive``, a search of its own with these bounds.

Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part, nor do vectors whose squared
integer norm is over 2^62 (scores would not fit a long). Vectors of different lengths have no inner product: each length is mined by itself. Of rows that
repeat an id the one with the least label, then vector counts. Ties go to smaller ids. A positive with a score below zero has
no window. An anchor without positives, or with none that has negatives, gives no rows, and so does an empty table. Only the id, the label
and the vector are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.common import drawn, materialize, release, table

NONE = -(1 << 63)
EXACT = 1 << 53  # sums of products below this are exact in doubles


class Splits:
    """A vantage-point tree by distance: inner nodes have a vantage point and a radius, and leaves are regions.

    ``points`` are augmented vectors. ``path[r]`` lists (node, least, greatest distance to its point) for region r.
    """

    def __init__(self, points: np.ndarray, regions: int, seed: int = 5):
        r = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []  # nodes, or regions as -1 - r
        self.path: list[list[tuple[int, float, float]]] = []
        self.root = self._split(points, max(1, regions), [], r)

    def _split(self, x: np.ndarray, regions: int, path: list, r: np.random.Generator) -> int:
        if regions > 1 and len(x) > 1:
            v = x[int(r.integers(len(x)))]
            d = np.sqrt(((x - v) ** 2).sum(1))
            cut = float(np.quantile(d, (regions // 2) / regions))
            inside = d <= cut
            if not inside.all():
                node = len(self.centres)
                self.centres.append(v)
                self.radius.append(cut)
                self.children.append([])
                a = self._split(x[inside], regions // 2, [*path, (node, 0.0, cut)], r)
                b = self._split(x[~inside], regions - regions // 2, [*path, (node, cut, np.inf)], r)
                self.children[node] = [a, b]
                return node
        self.path.append(path)
        return -len(self.path)

    def _distances(self, x: np.ndarray) -> np.ndarray:
        if not self.centres:
            return np.zeros((len(x), 0))
        c = np.array(self.centres)
        return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T))

    def place(self, x: np.ndarray) -> np.ndarray:
        """The region of each augmented vector."""
        d = self._distances(x)
        at = np.full(len(x), self.root)
        while (at >= 0).any():
            for node in np.unique(at[at >= 0]):
                own = at == node
                a, b = self.children[node]
                at[own] = np.where(d[own, node] <= self.radius[node], a, b)
        return -1 - at

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) distance of each query to each region's vectors."""
        d = self._distances(q)
        low, high = np.zeros((len(q), len(self.path))), np.full((len(q), len(self.path)), np.inf)
        for r, path in enumerate(self.path):
            for node, a, b in path:
                low[:, r] = np.maximum(low[:, r], np.maximum(a - d[:, node], d[:, node] - b))
                high[:, r] = np.minimum(high[:, r], d[:, node] + b)
        return low, high


def _augmented(x: np.ndarray, top: float) -> np.ndarray:
    y = x.astype(np.float64)
    return np.hstack((y, np.sqrt(np.maximum(0, top - (y * y).sum(1, keepdims=True)))))


def build_tree(x: np.ndarray, top: float, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's tree over rows ``x``: (order of rows, node vantage rows, node bounds (inner low, high, outer low, high), leaf ends).

    Halved by rank of distance, so that equal vectors part as well. Nodes are numbered level by level: a node's
    children are 2i + 1 and 2i + 2.
    """
    y = _augmented(x, top)
    depth = 0
    while len(x) > leaf << depth:
        depth += 1
    parts = [np.arange(len(x))]
    vantage, bounds = [], []
    for _ in range(depth):
        halves = []
        for own in parts:
            v = own[0]
            d = np.sqrt(((y[own] - y[v]) ** 2).sum(1))
            order = np.argsort(d, kind="stable")
            m = (len(own) + 1) // 2
            vantage.append(v)
            bounds.append((d[order[0]], d[order[m - 1]], d[order[min(m, len(own) - 1)]], d[order[-1]]))
            halves += [own[order[:m]], own[order[m:]]]
        parts = halves
    return np.concatenate(parts), np.array(vantage, np.int64), np.array(bounds, np.float64).reshape(-1, 4), np.cumsum([len(p) for p in parts])


def leaf_bounds(d: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) distance of each query to each leaf, from its distances to the vantage points."""
    low, high = np.zeros((len(d), 1)), np.full((len(d), 1), np.inf)
    node = 0
    while node < len(bounds):
        width = low.shape[1]
        own, b = d[:, node : node + width], bounds[node : node + width]
        two = lambda a, c: np.stack((a, c), 2).reshape(len(d), 2 * width)
        low, high = (
            two(np.maximum(low, np.maximum(b[:, 0] - own, own - b[:, 1])), np.maximum(low, np.maximum(b[:, 2] - own, own - b[:, 3]))),
            two(np.minimum(high, own + b[:, 1]), np.minimum(high, own + b[:, 3])),
        )
        node += width
    return low, high


def search_block(queries: dict[str, np.ndarray], block: dict[str, np.ndarray], top: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids), each query's ``k`` best rows of a block, missing ones with the score ``NONE``.

    queries: x, anchor (id), label, same (whether the label is to be the same), low and high (scores, inclusive), floor (a score
    that must be reached). block: x, ids, labels, vantage, bounds, ends.
    """
    q, x = queries["x"], block["x"]
    exact = np.float64 if top < EXACT else np.int64
    q, x = q.astype(exact), x.astype(exact)
    norm = (q.astype(np.float64) ** 2).sum(1)
    slack = 1e-6 * (np.sqrt(top) + np.sqrt(norm))[:, None] + 1e-6
    y = _augmented(block["x"][block["vantage"]], top) if len(block["vantage"]) else np.zeros((0, q.shape[1] + 1))
    d = np.sqrt(np.maximum(0, norm[:, None] + top - 2 * q.astype(np.float64) @ y[:, :-1].T)) if len(y) else np.zeros((len(q), 0))
    low, high = leaf_bounds(d, block["bounds"])
    best = (norm[:, None] + top - np.maximum(0, low - slack) ** 2) / 2 + 1e-9 * top + 1  # no row of the leaf scores higher
    worst = np.where(np.isinf(high), -np.inf, (norm[:, None] + top - (high + slack) ** 2) / 2 - 1e-9 * top - 1)
    best = np.where((best < queries["low"][:, None]) | (worst > queries["high"][:, None]), -np.inf, best)
    order = np.argsort(-best, axis=1, kind="stable")
    starts = np.concatenate(([0], block["ends"][:-1]))
    scores, ids = np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max)
    going = np.arange(len(q))
    for step in range(order.shape[1]):
        leaf = order[going, step]
        reach = best[going, leaf]
        live = (reach >= queries["floor"][going]) & (reach >= scores[going, -1].astype(np.float64)) & np.isfinite(reach)
        going, leaf = going[live], leaf[live]
        if not len(going):
            break
        for own in np.unique(leaf):
            who = going[leaf == own]
            a, b = starts[own], block["ends"][own]
            s = (q[who] @ x[a:b].T).astype(np.int64)
            fits = (block["labels"][a:b][None, :] == queries["label"][who][:, None]) == queries["same"][who][:, None]
            fits &= (block["ids"][a:b][None, :] != queries["anchor"][who][:, None]) & (s >= np.maximum(queries["low"], queries["floor"])[who][:, None]) & (s <= queries["high"][who][:, None])
            hit = fits.any(1)
            if not hit.any():
                continue
            who, s, fits = who[hit], s[hit], fits[hit]
            both = np.hstack((scores[who], np.where(fits, s, NONE)))
            every = np.hstack((ids[who], np.where(fits, block["ids"][a:b][None, :], np.iinfo(np.int64).max)))
            first = np.lexsort((every, -both.astype(np.float64) if top < EXACT else ~both))[:, :k]
            scores[who], ids[who] = np.take_along_axis(both, first, 1), np.take_along_axis(every, first, 1)
    return scores, ids


QUERY = "qid long, anchor_id long, x binary, label int, same boolean, low long, high long"
FOUND = "qid long, score long, vec_id long"


def _flat(column: pa.Array) -> np.ndarray:
    """A column of binary values, each one row of longs."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), -1)


class Index:
    """Blocks of vectors of one length, by region, in a written table."""

    def __init__(self, rows: DataFrame, top: float, n: int, *, regions: int, block: int, leaf: int, sample: int):
        """``rows(vec_id, label, v array<long>)``; ``top`` is the greatest squared norm."""
        self.top = float(top)
        drawn_rows = np.array(drawn(rows.select("vec_id", "v"), "vec_id", sample, 11).toArrow()["v"].to_pylist(), np.int64)
        self.splits = splits = Splits(_augmented(drawn_rows, self.top), min(regions, -(-n // block)))
        top = self.top

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(splits.place(_augmented(x, top)).astype(np.int32)), b.column(0), b.column(1), pa.array([v.tobytes() for v in x], pa.binary())], names=["region", "vec_id", "label", "x"])

        placed = materialize(rows.mapInArrow(place, "region int, vec_id long, label int, x binary"))
        counts = {r["region"]: r["n"] for r in placed.groupBy("region").agg(F.count("*").alias("n")).collect()}  # at most ``regions`` rows
        pieces = F.get(F.array(*[F.lit(-(-counts.get(r, 1) // block)) for r in range(len(splits.path))]), F.col("region"))
        grouped = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), pieces)).groupBy("region", "part").agg(F.collect_list(F.struct("vec_id", "label", "x")).alias("rows"))  # about ``block`` vectors

        def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    own = b.column(1)[k].values
                    ids, labels, x = own.field("vec_id").to_numpy(), own.field("label").to_numpy().astype(np.int32), _flat(own.field("x"))
                    first = np.argsort(ids, kind="stable")
                    ids, labels, x = ids[first], labels[first], x[first]
                    order, vantage, bounds, ends = build_tree(x, top, leaf)
                    at = np.empty(len(order), np.int64)
                    at[order] = np.arange(len(order))
                    blobs = [x[order], ids[order], labels[order], at[vantage] if len(vantage) else vantage, bounds, ends.astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), *[pa.array([y.tobytes()], pa.binary()) for y in blobs]], names=["region", "bx", "ids", "labels", "vantage", "bounds", "ends"])

        self.blocks = materialize(grouped.select("region", "rows").mapInArrow(plant, "region int, bx binary, ids binary, labels binary, vantage binary, bounds binary, ends binary"))
        release(placed)

    def search(self, queries: DataFrame, k: int, *, first: int = 2, chunk: int = 512) -> DataFrame:
        """(qid, score, vec_id): the ``k`` best of each of ``queries`` (:data:`QUERY`), in any order.

        The ``first`` regions by distance are visited, then those that can still hold better rows.
        """
        asked = materialize(queries)
        found = self._visit(asked.withColumn("floor", F.lit(NONE)), k, chunk, first, True)
        if len(self.splits.path) > first:
            kth = found.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            floors = materialize(asked.join(kth, "qid", "left").select(asked["*"], F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(NONE)).alias("floor")))
            found = _merged(found.unionByName(self._visit(floors, k, chunk, first, False)), k)
            release(floors)
        return found

    def _visit(self, asked: DataFrame, k: int, chunk: int, first: int, nearest: bool) -> DataFrame:
        splits, top = self.splits, self.top

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _flat(b.column(2)).astype(np.float64)
                low, high = splits.bounds(np.hstack((x, np.zeros((len(x), 1)))))
                norm = (x * x).sum(1)
                slack = 1e-6 * (np.sqrt(top) + np.sqrt(norm))[:, None] + 1e-6
                best = (norm[:, None] + top - np.maximum(0, low - slack) ** 2) / 2 + 1e-9 * top + 1
                worst = np.where(np.isinf(high), -np.inf, (norm[:, None] + top - (high + slack) ** 2) / 2 - 1e-9 * top - 1)
                least, most, floor = (b.column(i).to_numpy()[:, None] for i in (5, 6, 7))
                fits = (best >= least) & (worst <= most)
                place = np.argsort(np.argsort(np.where(fits, -best, np.inf), axis=1, kind="stable"), axis=1, kind="stable")
                fits &= place < first if nearest else (place >= first) & (best >= floor)
                q, r = np.nonzero(fits)
                yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), b.column(0).take(pa.array(q))], names=["region", "qid"])

        visits = materialize(asked.mapInArrow(route, "region int, qid long"))
        counts = {r["region"]: r["n"] for r in visits.groupBy("region").agg(F.count("*").alias("n")).collect()}  # at most ``regions`` rows
        if not counts:
            return asked.sparkSession.createDataFrame([], FOUND)
        pieces = F.get(F.array(*[F.lit(-(-counts.get(r, 1) // chunk)) for r in range(len(splits.path))]), F.col("region"))
        dealt = visits.join(asked, "qid").withColumn("part", F.pmod(F.xxhash64("qid"), pieces))
        chunks = dealt.groupBy("region", "part").agg(F.collect_list(F.struct("qid", "anchor_id", "x", "label", "same", "low", "high", "floor")).alias("qs"))  # about ``chunk`` queries
        work = materialize(chunks.select("region", "qs")).join(self.blocks, "region")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    qs = b.column(1)[i].values
                    num = lambda f, qs=qs: qs.field(f).to_numpy(zero_copy_only=False)
                    queries = {"x": _flat(qs.field("x")), "anchor": num("anchor_id"), "label": num("label"), "same": num("same").astype(bool), "low": num("low"), "high": num("high"), "floor": num("floor")}
                    get = lambda c, kind, b=b, i=i: np.frombuffer(b.column(c)[i].as_py(), kind)
                    ids = get(3, np.int64)
                    block = {"x": get(2, np.int64).reshape(len(ids), -1), "ids": ids, "labels": get(4, np.int32), "vantage": get(5, np.int64), "bounds": get(6, np.float64).reshape(-1, 4), "ends": get(7, np.int64)}
                    scores, found = search_block(queries, block, top, k)
                    q, at = np.nonzero(scores != NONE)
                    yield pa.RecordBatch.from_arrays([pa.array(num("qid")[q]), pa.array(scores[q, at]), pa.array(found[q, at])], names=["qid", "score", "vec_id"])

        return materialize(_merged(work.mapInArrow(run, FOUND), k))


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query. Tasks keep theirs first, so a query's rows in the shuffle are at most ``k`` from each."""
    return _placed(found, k).drop("rank")


def _placed(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _valid(vectors: DataFrame, id_col: str, label: Column, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v, norm) of the rows that take part, one for each id."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("int").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and label is not null and size(v) > 0")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(2.0**31 / scale)))
    whole = v.where(sound).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return whole.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", "m.v").withColumn("norm", norm).where(F.col("norm") < 2.0**62)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    scale: int = 256,
    id_col: str = "vec_id",
    label: Column | None = None,
    vector_col: str = "embedding",
    regions: int = 1024,
    block: int = 512,
    leaf: int = 64,
    sample: int = 4096,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``is_anchor`` is over ``vec_id``."""
    if min(positives, negatives, scale, block, leaf, sample, regions) < 1 or not 0 <= percent <= 100:
        raise ValueError("counts must be positive, percent from 0 to 100")
    rows = materialize(_valid(vectors, id_col, F.col("label") if label is None else label, vector_col, scale))
    kinds = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max("norm").alias("top"), F.max(is_anchor.cast("int")).alias("asked")).where("n > 1 and asked = 1").collect()  # a row for each length
    out = rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for kind in sorted(kinds):
        own = rows.where(F.size("v") == kind["d"]).select("vec_id", "label", "v")
        index = Index(own, kind["top"], kind["n"], regions=regions, block=block, leaf=leaf, sample=sample)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.tobytes() for v in x], pa.binary())], names=["anchor_id", "label", "x"])

        anchors = materialize(own.where(is_anchor).mapInArrow(packed, "anchor_id long, label int, x binary"))
        wide = F.lit((1 << 63) - 1)
        near = index.search(anchors.select(F.col("anchor_id").alias("qid"), "anchor_id", "x", "label", F.lit(True).alias("same"), F.lit(NONE + 1).alias("low"), wide.alias("high")), positives)
        pairs = near.where("score >= 0").select(F.col("qid").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        windows = materialize(pairs.join(anchors, "anchor_id").withColumn("qid", F.monotonically_increasing_id()))
        # 100 n >= percent * p: the least whole n
        least = F.expr(f"(positive_score div 100) * {percent} + (positive_score % 100 * {percent} + 99) div 100")
        asked = windows.select("qid", "anchor_id", "x", "label", F.lit(False).alias("same"), least.alias("low"), F.col("positive_score").alias("high"))
        far = _placed(index.search(asked, negatives), negatives)
        found = far.join(windows.select("qid", "anchor_id", "positive_id", "positive_score"), "qid")
        out = out.unionByName(found.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    flipped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=flipped)
