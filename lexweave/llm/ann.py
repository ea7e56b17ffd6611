"""Approximate nearest neighbours by multiprobe p-stable hashing.

Nearness is the largest inner product. Vectors are scaled by the greatest norm and
get one more component that makes them unit vectors, so near in this sense means near in
distance. A table hashes with ``floor((a . x + b) / w)`` for Gaussian ``a``; a query
visits its own bucket and buckets with coordinates off by one, in order of the estimated
chance of success: the sum of squared distances to the boundaries crossed (Lv et
al., 2007). Candidates of all tables are merged and ranked by their exact inner
products in double precision on the original vectors.

The number of coordinates follows from the number of vectors (buckets of about
``bucket`` vectors) and falls until the sample's neighbours are found, the number of visits from a sample of at most ``sample`` vectors: as
many as bring in ``target`` of the sample's neighbours that are as rare as the ``k``
nearest of all. Every vector is indexed. Buckets of any size are cut into blocks of
about ``block`` vectors, and a bucket's queries into chunks, so a bucket with a third of all vectors
is many tasks' work and nothing is capped. A query whose buckets hold fewer than ``k``
candidates visits all buckets of the first table instead, and so is exact; so are all queries if no
buckets bring in ``target`` of the sample's neighbours.

Vectors that are null, zero, or hold null or non-finite components take no part.
Vectors of different lengths have no inner product: each length is searched by itself. Ties go to the smaller vec_id. Of rows that
repeat a vec_id the one with the least components counts. With fewer than ``k`` candidates all are returned. An
empty table gives no rows. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import drawn, materialize, mix64, release, table

HALF = 6
MOST_VISITS = 4096


class Hashes:
    """``tables`` tables of ``k`` hashes each over unit vectors of ``dim`` components."""

    def __init__(self, dim: int, k: int, tables: int, width: float, top: float, seed: int = 3):
        r = np.random.default_rng(seed)
        self.a = r.normal(size=(tables, dim + 1, k))
        self.b = r.uniform(0, width, (tables, k))
        self.k, self.tables, self.width, self.top = k, tables, width, top

    def unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            return np.hstack((x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))))
        y = x / self.top
        return np.hstack((y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1, keepdims=True)))))

    def place(self, unit: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and the place within each cell in widths."""
        f = (unit @ self.a[t] + self.b[t]) / self.width
        cells = np.floor(f)
        return cells.astype(np.int64), f - cells

    def keys(self, cells: np.ndarray, t: int) -> np.ndarray:
        h = np.full(len(cells), np.uint64(t + 1), np.uint64)
        for j in range(self.k):
            h = mix64(h ^ cells[:, j].astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        return h.view(np.int64)

    def steps(self, inside: np.ndarray, visits: int) -> np.ndarray:
        """For one query the first ``visits`` offsets (rows of -1, 0, 1), likeliest first."""
        cost = np.stack((inside**2, np.zeros_like(inside), (1 - inside) ** 2))  # of -1, 0, +1
        parts = []
        for lo in range(0, self.k, HALF):
            own = np.array(list(product((-1, 0, 1), repeat=min(HALF, self.k - lo))))
            score = cost[own + 1, np.arange(lo, lo + own.shape[1])].sum(1)
            best = np.argsort(score, kind="stable")[:visits]
            parts.append((own[best], score[best]))
        offsets, score = parts[0]
        for more, extra in parts[1:]:
            both = (score[:, None] + extra[None, :]).ravel()
            best = np.argsort(both, kind="stable")[:visits]
            offsets, score = np.hstack((offsets[best // len(extra)], more[best % len(extra)])), both[best]
        return offsets


def fit(sample: np.ndarray, n: int, top: float, *, tables: int, bucket: int, target: float, nearest: int) -> tuple[Hashes, int] | None:
    """Hashes and the number of visits, from a sample of at most a few thousand vectors; None if no buckets bring in enough of its neighbours."""
    most = int(np.clip(round(np.log(max(n / bucket, 1)) / np.log(2.6)), 1, 2 * HALF))
    r = max(1, round(nearest * len(sample) / max(n, 1)))
    asked = sample[:: max(1, len(sample) // 300)]
    own = np.arange(0, len(sample), max(1, len(sample) // 300))
    inner = asked @ sample.T
    inner[np.arange(len(asked)), own] = -np.inf
    near = np.argsort(-inner, axis=1)[:, : min(r, max(1, len(sample) - 1))]
    for k in range(most, 0, -1):  # larger buckets where smaller ones part too many neighbours
        limit = min(3**k, MOST_VISITS)
        for width in (2.5, 3.2, 4.2, 5.5, 8.0, 16.0):
            hashes = Hashes(sample.shape[1], k, tables, width, top)
            ranks = np.full(near.shape, limit, np.int64)
            for t in range(tables):
                cells, _ = hashes.place(hashes.unit(sample, False), t)
                home, inside = hashes.place(hashes.unit(asked, True), t)
                for i in range(len(asked)):
                    order = {tuple(o): j for j, o in enumerate(hashes.steps(inside[i], limit).tolist())}
                    for j, m in enumerate(near[i]):
                        ranks[i, j] = min(ranks[i, j], order.get(tuple((cells[m] - home[i]).tolist()), limit))
            need = int(np.quantile(ranks, target)) + 1
            if need <= limit:
                return hashes, min(need + need // 8 + 1, 3**k)
    return None


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.where(finite & F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest with ties to smaller ids."""
    if len(scores) > 4 * k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _merge(a: tuple | None, b: tuple, k: int) -> tuple:
    if a is None:
        return b
    ids, at = np.unique(np.concatenate((a[1], b[1])), return_index=True)
    return _best(np.concatenate((a[0], b[0]))[at], ids, k)


FOUND = "query_id long, scores array<double>, ids array<long>"


def _emit(best: dict[int, tuple]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array([b[0] for b in best.values()], pa.list_(pa.float64())), pa.array([b[1] for b in best.values()], pa.list_(pa.int64()))], names=["query_id", "scores", "ids"])
    best.clear()
    return out


def _dealt(probes: DataFrame, chunk: int) -> DataFrame:
    """(tab, key, qs): about ``chunk`` queries of a bucket in a row."""
    visits = materialize(probes.groupBy("tab", "key").agg(F.count("*").alias("c")))
    dealt = probes.join(visits, ["tab", "key"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.ceil(F.col("c") / chunk)))
    return dealt.groupBy("tab", "key", "part").agg(F.collect_list(F.struct("query_id", "q")).alias("qs")).drop("part")


def _search_all(queries: DataFrame, blocks: DataFrame, chunk: int, k: int, slots: int = 64) -> DataFrame:
    """``queries(query_id, q)`` against every block: chunks of queries meet each slot of blocks, and blocks each chunk's number."""
    n = -(-queries.count() // chunk)
    chunks = queries.withColumn("tab", F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(n)).cast("int")).groupBy("tab").agg(F.collect_list(F.struct("query_id", "q")).alias("qs"))
    chunks = chunks.withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    every = blocks.select(F.pmod(F.xxhash64("key"), F.lit(slots)).cast("long").alias("key"), "vs").withColumn("tab", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return _search(chunks, every, ["tab", "key"], k)


def _search(chunks: DataFrame, blocks: DataFrame, on: list[str], k: int) -> DataFrame:
    """(query_id, scores, ids) of the ``k`` best of the blocks that ``chunks(tab, key, qs)`` visit."""
    work = chunks.join(blocks, on).select(F.col("qs.query_id").alias("qi"), F.col("qs.q").alias("qv"), F.col("vs.vec_id").alias("vi"), F.col("vs.x").alias("vv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                qi, qv, vi, vv = (batch.column(c)[row].as_py() for c in range(4))
                inner, ids = _matrix(qv) @ _matrix(vv).T, np.array(vi, np.int64)
                for i, q in enumerate(qi):
                    other = ids != q
                    if other.any():
                        best[q] = _merge(best.get(q), _best(inner[i][other], ids[other], k), k)
                if len(best) > 50_000:
                    yield _emit(best)
        if best:
            yield _emit(best)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        last = None
        for batch in batches:
            for q, s, i in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if q != last and len(best) >= 2_000:
                    yield _emit(best)
                best[q] = _merge(best.get(q), (np.array(s), np.array(i, np.int64)), k)
                last = q
        if best:
            yield _emit(best)

    partial = work.mapInArrow(run, FOUND)
    return partial.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, FOUND)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = 2,
    bucket: int = 192,
    block: int = 512,
    target: float = 0.96,
    sample: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest of each vector for which ``is_query`` (over vec_id) holds."""
    valid = _valid(vectors, id_col, vector_col)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    kinds = valid.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("top")).collect()  # one row for each length
    none = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not kinds:
        return none
    valid = materialize(valid)
    parts = [_nearest(valid.where(F.size("v") == r["d"]), is_query, r["n"], float(r["top"]) or 1.0, k, tables, bucket, block, target, sample) for r in sorted(kinds) if r["n"] > 1]
    out = none
    for found in parts:
        out = out.unionByName(found)
    return out


def _nearest(valid: DataFrame, is_query: Column, n: int, top: float, k: int, tables: int, bucket: int, block: int, target: float, sample: int) -> DataFrame:
    """The search among ``n`` vectors of one length."""
    fitted = drawn(valid, "vec_id", sample, 1).toArrow()
    found_fit = fit(np.array(fitted["v"].to_pylist(), np.float64), n, top, tables=tables, bucket=bucket, target=target, nearest=k)
    hashes, visits = found_fit or (Hashes(len(fitted["v"][0]), 1, 1, 16.0, top), 0)
    used = hashes.tables

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            unit = hashes.unit(x, False)
            for t in range(used):
                keys = hashes.keys(hashes.place(unit, t)[0], t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(keys), batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["tab", "key", "vec_id", "x"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            unit, ids = hashes.unit(x, True), batch.column(0).to_numpy()
            for t in range(used):
                home, inside = hashes.place(unit, t)
                for i in range(len(x)):
                    keys = hashes.keys(home[i] + hashes.steps(inside[i], visits), t)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int32)), pa.array(keys), pa.array(np.full(len(keys), ids[i]))], names=["tab", "key", "query_id"])

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)], pa.binary())], names=["query_id", "q"])

    placed = materialize(valid.mapInArrow(index, "tab int, key long, vec_id long, x binary"))
    counts = materialize(placed.groupBy("tab", "key").agg(F.count("*").alias("c")))
    cut = placed.join(counts, ["tab", "key"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("c") / block)))
    blocks = materialize(cut.groupBy("tab", "key", "part").agg(F.collect_list(F.struct("vec_id", "x")).alias("vs")).select("tab", "key", "vs"))  # about `block` vectors
    release(placed)
    queries = valid.where(is_query)
    wanted = min(k, n - 1)
    asked = materialize(queries.mapInArrow(as_bytes, "query_id long, q binary"))
    few, out = asked, None
    if visits:
        # probes travel as ids; vectors come to those whose bucket is there
        probes = queries.mapInArrow(probe, "tab int, key long, query_id long").join(counts.select("tab", "key"), ["tab", "key"], "left_semi").join(asked, "query_id")
        out = materialize(_search(_dealt(probes, block), blocks, ["tab", "key"], k))
        few = materialize(asked.join(out.where(F.size("ids") >= wanted).select("query_id"), "query_id", "left_anti"))
        out = out.where(F.size("ids") >= wanted)
    if not few.isEmpty():
        exact = _search_all(few, blocks.where("tab = 0"), block, k)
        out = exact if out is None else out.unionByName(exact)
    if out is None:
        out = asked.select("query_id", F.array().cast("array<double>").alias("scores"), F.array().cast("array<long>").alias("ids"))
    out = out.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
