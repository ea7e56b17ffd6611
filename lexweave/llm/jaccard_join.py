"""Exact Jaccard self-join of documents on word shingles, by grouped prefixes.

A document's set holds its distinct five-word shingles (fewer words: the whole
sequence as one). Two documents link when |A ∩ B| / |A ∪ B| >= threshold, which is
checked in whole numbers. The result is each document's component of links.

1. Equal sets collapse into one class, whose least doc_id stands for it.
2. A set's prefix is its first ``n - ceil(t * n) + 1`` shingles in one global
   order: shingles seen often come last (counted over all documents, see
   ``frequent_shingles``; the order steers cost only, never the result), the rest
   by hash. Sets that link share a prefix shingle. Shingles that one class only
   has can't match, so they leave the prefix.
3. Classes with the same remaining prefix and size form a group.
4. First passes: each member is checked against a few members of its group, and each
   group against one group of every prefix shingle and size band (later each member), all drawn by hash: pairs grow
   with the rows of the index, not with their square. Links merge into components.
5. Closing pass: only prefix shingles that still see more than one component are
   left. Their members of different components pair if sizes, the shingle's places in
   either set and the sets' parities leave room for a link, and are then checked. So every pair of different sets
   that could link is either checked or already known to be connected.

Empty or null text: an empty set, linked with nothing. Null doc_id: no part in
the join and no row. Of rows that repeat a doc_id the one with the smallest set (then the
least keys) counts, in one row. An empty table gives no rows. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.common import hash_shingles, hash_words, free_names, materialize, mix64, release, table, text_slices, top_counts, unique_sorted
from lexweave.llm.components import connected_components, partial_components

#: Bound of the driver's list of frequent shingles: 8 bytes each, with their counts.
FREQUENT = 65_536
BLOCK = 2_000_000
#: Rows of a frequent shingle that are dealt together.
PART = 4096


def frequent_shingles(docs: DataFrame, size: int, limit: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The shingles in most documents, sorted, with counts.

    Lossy counting over all documents: a task counts blocks of ``BLOCK`` set members
    and passes on those that it met more than once in a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            often = c > 1
            return pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(c[often].astype(np.int64))], names=["h", "c"])

        for _, texts in text_slices(batches, "text"):
            runs, begin = hash_shingles(*hash_words(texts), size)
            for a, b in zip(begin[:-1], begin[1:], strict=True):
                held.append(unique_sorted(runs[a:b]))
            n += len(runs)
            if n >= BLOCK:
                yield flush()
                n = 0
        if held:
            yield flush()

    counts = materialize(docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    top = top_counts(counts, limit)  # at most `limit` rows
    release(counts)
    h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def prefix_table(docs: DataFrame, size: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, n, kk, k1, k2, prefix, salts, bits): set size, keys of the set, its prefix, over how many parts each of its frequent members (the last) is dealt, parities.

    ``bits`` holds, for 512 slots of hashes, whether an odd number of members falls there: two sets
    differ in at least as many members as their slots differ (Sandes et al., 2017).

    A task gives the prefix of equal sets once only (null later), so copies don't multiply in the index.
    """
    often, count = frequent
    rank = np.empty(len(often), np.int64)
    rank[np.lexsort((often, count))] = np.arange(len(often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for part, texts in text_slices(batches, "text"):
            runs, begin = hash_shingles(*hash_words(texts), size)
            rows: list[tuple] = []
            for a, b in zip(begin[:-1], begin[1:], strict=True):
                u = unique_sorted(runs[a:b])
                n = len(u)
                k1 = int(np.bitwise_xor.reduce(u)) if n else 0
                k2 = int(mix64(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if n else 0
                prefix, bits, parts = None, None, None
                if n and (n, k1, k2) not in seen:
                    if len(seen) < 500_000:
                        seen.add((n, k1, k2))
                    p = n - -(-n * percent // 100) + 1
                    prefix, parts = u[:p], []
                    if len(often):
                        at = np.minimum(np.searchsorted(often, u), len(often) - 1)
                        hot = often[at] == u
                        if hot[:p].any():
                            cold = u[~hot][:p]
                            late = at[hot][np.argsort(rank[at[hot]])][: p - len(cold)]
                            prefix, parts = np.concatenate((cold, often[late])), 1 + count[late] // PART
                    prefix = prefix.view(np.int64)
                    bits = np.packbits(np.bincount((u & np.uint64(511)).astype(np.int64), minlength=512) & 1).view(np.int64)
                rows.append((n, k1 ^ (k2 << 1 & (1 << 64) - 1), k1, k2, prefix, parts, bits))
            n, kk, k1, k2, prefixes, parts, bits = zip(*rows, strict=True)
            keys = [pa.array(np.array(k, np.uint64).view(np.int64)) for k in (kk, k1, k2)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), *keys, pa.array(prefixes, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["doc_id", "n", "kk", "k1", "k2", "prefix", "salts", "bits"])

    return docs.mapInArrow(run, "doc_id long, n int, kk long, k1 long, k2 long, prefix array<long>, salts array<long>, bits array<long>")


#: Bits of the filter that spares documents outside the index the making of their sets.
FILTER_BITS = 1 << 25


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(rep, tokens) for the ids in ``wanted(rep, k1)``: an inner join after a fixed-size filter (4 MB) on the way.

    Texts are not shuffled, only the sets that pass the filter.
    """
    slot = lambda c: (F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1).cast("long")
    bits = wanted.select(slot("rep").alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    mask = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in bits.collect():  # at most FILTER_BITS / 32768 rows of 4 KB
        at = (r["b"] - 1) * 4096
        mask[at : at + 4096] = np.frombuffer(bytes(r["m"]), np.uint8)[:4096]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = batch.column(2).to_numpy(zero_copy_only=False) - 1
                yield batch.filter(pa.array((mask[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)))

        for part, texts in text_slices(passed(), "text"):
            runs, begin = hash_shingles(*hash_words(texts), size)
            sets = [unique_sorted(runs[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
            keys = [int(np.bitwise_xor.reduce(u)) if len(u) else 0 for u in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array([u.view(np.int64) for u in sets], pa.list_(pa.int64()))], names=["rep", "k1", "tokens"])

    made = docs.select("doc_id", "text", slot("doc_id").alias("s")).mapInArrow(run, "rep long, k1 long, tokens array<long>")
    return made.join(wanted, ["rep", "k1"]).dropDuplicates(["rep", "k1"]).select("rep", "tokens")


def _fits(percent: int, n: str = "n1", m: str = "n2") -> str:
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"


SLOTS = [f"s{k}" for k in range(8)]


def _early(percent: int) -> str:
    """Whether enough common members may follow a common shingle at pos1 and pos2, if it is the first."""
    need = f"{percent} * (n1 + n2) <= {100 + percent}"
    return f"{need} * (n1 - pos1) and {need} * (n2 - pos2)"


def _alike(percent: int, one: str = "1", two: str = "2") -> str:
    """Whether the parities leave room for a link: (100 + t) * differing members <= (100 - t) * (n1 + n2)."""
    apart = " + ".join(f"bit_count({s}{one} ^ {s}{two})" for s in SLOTS)
    return f"{100 + percent} * ({apart}) <= {100 - percent} * (n{one} + n{two})"


def _verified(pairs: DataFrame, per: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v) of the pairs whose sets reach the threshold.

    Members common to two sets are either in both prefixes, or beyond the end of the
    prefix that ends first. So a pair needs enough common prefix shingles to be worth a look
    at its sets, and only the sets of such pairs are made and shuffled.
    """
    t1, t2 = (per.select(F.col("rep").alias(k), F.col("toks").alias(f"t{k}"), F.col("n").alias(f"n{k}"), *[F.col(c).alias(f"{c}{k}") for c in SLOTS]) for k in "uv")
    seen = F.size(F.array_intersect("tu", "tv"))
    beyond = F.ceil(F.greatest("nu", "nv") * F.lit(percent) / F.lit(100)) - 1
    need = (F.col("nu") + F.col("nv")) * F.lit(percent)  # at most (100 + percent) * common
    pairs = pairs.join(t1, "u").join(t2, "v").where(_alike(percent, "u", "v"))
    pairs = materialize(pairs.where((seen + beyond) * F.lit(100 + percent) >= need).select("u", "v"))
    wanted = materialize(pairs.select(F.col("u").alias("rep")).union(pairs.select("v")).distinct().join(classes.select("rep", "k1"), "rep"))
    sets = materialize(sets_of(docs, wanted, size))
    left = sets.select(F.col("rep").alias("u"), F.col("tokens").alias("tu"))
    right = sets.select(F.col("rep").alias("v"), F.col("tokens").alias("tv"))
    both = pairs.join(left, "u").join(right, "v")
    common = F.size(F.array_intersect("tu", "tv"))
    both = both.select("u", "v", common.cast("long").alias("i"), (F.size("tu").cast("long") + F.size("tv")).alias("s"))
    out = materialize(both.where(f"100 * i >= {percent} * (s - i)").select("u", "v"))
    release(pairs, sets, wanted)
    return out


def _with_pivots(src: DataFrame, turn: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): each row of ``src(tok, pos, rep, n, label)`` and the pivot of its shingle and size band, if they could link; and the pivots, written."""
    src = src.withColumn("band", F.floor(F.log("n") / F.lit(0.2) + F.lit(turn % 2 / 2)))
    draw = F.struct(F.xxhash64("rep", "tok", F.lit(turn)).alias("h"), F.col("rep").alias("b"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("label").alias("label2"))
    pivots = materialize(src.groupBy("tok", "band").agg(F.min(draw).alias("p"), F.count("*").alias("c")).where("c > 1").select("tok", "band", "p.*"))
    met = src.withColumnsRenamed({"n": "n1", "pos": "pos1", "rep": "a"}).join(pivots, ["tok", "band"])
    return met.where("a <> b and (label is null or label <> label2)").where(_fits(percent)).where(_early(percent)).select("a", "b"), pivots


def _near_labels(links: DataFrame) -> DataFrame:
    """(node, component): the least node within two links, enough to tell between passes what is already connected."""
    ties = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ties.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m"))
    further = least.select(F.col("node").alias("m"), F.col("m").alias("component"))
    return least.join(further, "m").select("node", "component")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, passes: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document; the threshold is ``percent`` / 100."""
    docs = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").where("doc_id is not null")
    raw = materialize(prefix_table(docs, size, percent, frequent_shingles(docs, size)))
    keyed = raw.groupBy("doc_id", "n", "kk", "k1", "k2").agg(F.max("bits").alias("bits"))
    keyed = materialize(keyed.groupBy("doc_id").agg(F.min(F.struct("n", "kk", "k1", "k2", "bits")).alias("s")).select("doc_id", "s.*"))
    classes = materialize(keyed.where("n > 0").groupBy("n", "kk", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("bits").alias("bits")))

    # prefix shingles of two classes at least; frequent ones have them, and are dealt by class as well, over parts of about equal size
    entries = raw.where("prefix is not null").select(F.posexplode("prefix").alias("pos", "tok"), "n", "kk", "salts", (F.size("prefix") - F.size("salts")).alias("cold"))
    part = F.pmod("kk", F.get("salts", F.col("pos") - F.col("cold"))) + 1
    entries = entries.select("tok", F.when(F.col("pos") >= F.col("cold"), part).otherwise(0).cast("int").alias("salt"), "pos", "n", "kk")
    once = entries.repartition("tok", "salt").dropDuplicates(["tok", "salt", "n", "kk"])
    twice = once.withColumn("c", F.count("*").over(Window.partitionBy("tok", "salt"))).where("c > 1 or salt > 0")
    live = materialize(twice.select("tok", "pos", "n", "kk").join(classes.select("n", "kk", "rep"), ["n", "kk"]).select("tok", "pos", "rep", "n"))
    release(raw)

    # groups: same size and same remaining prefix
    toks = F.array_sort(F.collect_list(F.struct("tok", "pos")))  # bounded by one document's prefix
    per = live.groupBy("rep", "n").agg(toks.alias("places")).withColumn("toks", F.col("places.tok"))
    per = per.join(classes.select("rep", *[F.get("bits", F.lit(k)).alias(c) for k, c in enumerate(SLOTS)]), "rep")
    per = materialize(per.withColumn("g", F.xxhash64("toks", "n")))
    # aggregates are written before they meet the rows they were made of: both sides are then shuffles, and a hot key can be split
    groups = materialize(per.groupBy("g", "n").agg(F.min("rep").alias("gid")))
    members = materialize(per.select("rep", "n", "g").join(groups, ["g", "n"]).select("rep", "n", "gid"))
    index = per.join(members.where("rep = gid").select("rep"), "rep", "left_semi").select(F.inline("places"), F.col("rep").alias("gid"), "n")
    index = index.withColumn("label", F.lit(None).cast("long"))

    # first passes: each shingle has its own pivot in each size band, and each group a few, drawn by hash, so members of a
    # loose group meet many; bands shift by half from pass to pass; later passes take all members where components still meet
    links = tried = None
    made: list[DataFrame] = []
    for turn in range(passes):
        src = index.withColumnRenamed("gid", "rep") if turn == 0 else posted  # noqa: F821
        met, pivots = _with_pivots(src, turn, percent)
        own = [F.min(F.struct(F.xxhash64("rep", F.lit(turn), F.lit(k)), "rep")).alias(f"m{k}") for k in range(4)]
        own_pivots = members.groupBy("gid").agg(F.count("*").alias("c"), *own).where("c > 1").select("gid", F.explode(F.array("gid", *[f"m{k}.rep" for k in range(4)])).alias("b"))
        own_pivots = materialize(own_pivots.distinct())
        inner = members.join(own_pivots, "gid").where("rep <> b").select(F.col("rep").alias("a"), "b")
        met = met.unionByName(inner).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        if turn:
            u, v = (labels.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")) for k in "uv")
            met = met.join(u, "u", "left").join(v, "v", "left").where("coalesce(cu, u) <> coalesce(cv, v)").select("u", "v").join(tried, ["u", "v"], "left_anti")
        pairs = materialize(met)
        release(pivots, own_pivots)
        found = _verified(pairs, per, classes, docs, size, percent)
        links, tried = (found, pairs) if links is None else (links.unionByName(found), tried.unionByName(pairs))
        near, forest = partial_components(links, 3) if turn == passes - 1 else (_near_labels(links), None)
        labels = materialize(near)
        posted = live.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("tok", "pos", "rep", "n", F.coalesce("component", "rep").alias("label"))
        mixed = materialize(posted.groupBy("tok").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("tok"))
        fresh = materialize(posted.join(mixed, "tok"))
        release(mixed, *made)
        made = [labels, fresh]
        posted = fresh

    # closing pass
    full = posted.join(per.select("rep", *SLOTS), "rep")
    m1, m2 = (full.select("tok", *[F.col(c).alias(f"{c}{k}") for c in ("label", "rep", "n", "pos", *SLOTS)]) for k in (1, 2))
    cross = m1.join(m2, "tok").where("label1 < label2").where(_fits(percent)).where(_early(percent)).where(_alike(percent)).select(F.col("rep1").alias("r1"), F.col("rep2").alias("r2"))
    cross = cross.select(F.greatest("r1", "r2").alias("u"), F.least("r1", "r2").alias("v")).distinct()
    cross = cross.join(tried, ["u", "v"], "left_anti")
    more = _verified(cross, per, classes, docs, size, percent)
    final = connected_components(forest.unionByName(more))

    of = keyed.join(classes, ["n", "kk", "k1", "k2"], "left").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    return of.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **kwargs) -> DataFrame:
    """``docs`` without the documents that aren't the least of their component; columns are as they are, whatever their names.

    Rows without an id stay, and rows that repeat an id go or stay together; empty texts are linked with nothing and stay.
    """
    (name,) = free_names(docs, "_gone")
    gone = jaccard_components(docs, **kwargs).where("doc_id <> component_id").select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col(kwargs.get("id_col", "doc_id")) == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
