"""Ranked lexical search over a tiered index.

A term is a maximal run of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. A document's score for
an item is a sum over the item's terms, once each, of a weight of the term times an impact of its occurrences:

    w = floor(1000 ln((2N + 2) / (2 df + 1)))        impact = (10^9 tf) div (1000 tf + 20 m)        m = 50 + (50 n N) div L

1. One pass over the texts writes a row for each document: its length, and the counts of those terms that a filter of fixed size
   lets pass, which holds all terms of the items.
2. A histogram of impacts for each term sets the tiers: the first holds a term's highest impacts, as many whole bins as
   have ``tiers[0]`` postings together, the second as many as have ``tiers[1]``. The greatest impact below a tier is
   the term's residual bound there. The last tier is every document's row.
3. For each item the postings of a tier are summed. What a document can have at most is that sum and the residuals of the terms
   it wasn't seen with; a document seen with none has at most all residuals. If these are below the k-th best sum so
   far, the tier proves that no other document is among the best: its candidates that can still be are scored from
   their rows. Items without that proof go on to the next tier, in the end to all rows, in blocks of items.

Scores are exact integers in every tier; the tiers only decide which rows are looked at.

A null or empty text, or one without terms, isn't a document (it isn't counted in N). Items without terms, and null item ids, give
no rows; rows that repeat an item_id are one item with the terms of all. Repeated rows and ids of documents are ranked
each; ties go to the smaller doc_id, null last. Very long texts are one row of counts. Empty tables give no rows.
Only ids and texts are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.common import bit_filter, hash_words, materialize, passing, release, table, text_slices

BIN = 4096  # of impacts, which are at most a million
FINE = 32  # bins for each doubling of a sum
BLOCK_ITEMS, BLOCK_PAIRS = 128, 1 << 15
ENTRIES = 8192


def _counts(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the hashes of each text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(fresh)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, h): the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            text, h, _ = _counts(*hash_words(texts, terms=True))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(h.view(np.int64))], names=["item_id", "h"])

    asked = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null")
    return asked.mapInArrow(run, "item_id long, h long").distinct()


def term_counts(docs: DataFrame, mask: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, hs, tfs) of every document with a term: all its terms are counted in ``n``, those that pass ``mask`` are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            words, first = hash_words(texts, terms=True)
            keep = passing(mask, words)
            kept = np.concatenate(([0], np.cumsum(keep)))[first]
            text, h, c = _counts(words[keep], kept)
            n = np.diff(first)
            ends = pa.array(np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(c.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "hs", "tfs"]).filter(pa.array(n > 0))

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    return read.mapInArrow(run, "doc_id long, n long, hs array<long>, tfs array<int>")


def _impact(n_docs: int, n_terms: int) -> str:
    return f"(1000000000L * tf) div (1000L * tf + 20L * (50L + (50L * n * {n_docs}L) div {n_terms}L))"


def build_tiers(rows: DataFrame, n_docs: int, n_terms: int, tiers: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(terms, postings) of ``rows(rid, n, hs, tfs)``.

    terms(h, w, b1, r1, b2, r2): the weight, each tier's least impact and the residual bound below it. postings(h, rid, f, tier): those of
    the first two tiers.
    """
    each = rows.select("rid", "n", F.inline(F.arrays_zip(F.col("hs").alias("h"), F.col("tfs").alias("tf")))).select("rid", "h", F.expr(_impact(n_docs, n_terms)).alias("f"))
    bins = each.groupBy("h", F.floor(F.col("f") / BIN).cast("int").alias("b")).agg(F.count("*").alias("c"), F.min("f").alias("low"), F.max("f").alias("top"))
    so_far = F.sum("c").over(Window.partitionBy("h").orderBy(F.desc("b")))  # a term has at most 245 bins
    upto = bins.withColumn("so_far", so_far)
    cut = [F.coalesce(x, F.lit(d)).alias(n) for k, t in enumerate(tiers, 1) for n, x, d in ((f"b{k}", F.min(F.when(F.col("so_far") <= t, F.col("low"))), 1 << 30), (f"r{k}", F.max(F.when(F.col("so_far") > t, F.col("top"))), 0))]
    weight = F.floor(F.lit(1000) * F.ln((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    terms = materialize(upto.groupBy("h").agg(F.sum("c").alias("df"), *cut).withColumn("w", weight))
    postings = each.join(terms.select("h", "b1", "b2"), "h").where("f >= b2").select("h", "rid", "f", F.when(F.col("f") >= F.col("b1"), 1).otherwise(2).alias("tier"))
    return terms, materialize(postings)


def _kth(found: list, items: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each item's k-th best sum, from (item, bin, count)."""
    theta = np.zeros(len(items))
    at = {int(x): i for i, x in enumerate(items)}
    seen = np.zeros(len(items), np.int64)
    for r in sorted(found, key=lambda r: (r["item_id"], -r["b"])):
        i = at[r["item_id"]]
        if seen[i] < k <= seen[i] + r["c"]:
            theta[i] = np.floor(2.0 ** (r["b"] / FINE) * (1 - 1e-9))
        seen[i] += r["c"]
    return theta


def _scores(rows: DataFrame, items: np.ndarray, pairs: pa.Table, theta: np.ndarray, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """(item_id, doc_id, score): the ``k`` best of each task's rows for each of ``items``, at least ``theta``, exactly."""
    item = np.searchsorted(items, pairs["item_id"].to_numpy())
    own = (item < len(items)) & (items[np.minimum(item, len(items) - 1)] == pairs["item_id"].to_numpy())
    item, h, w = item[own], pairs["h"].to_numpy()[own], pairs["w"].to_numpy()[own]
    terms, place = np.unique(h, return_inverse=True)
    weights = np.zeros((len(terms), len(items)), np.float32)  # below 2^17
    weights[place, item] = w

    def best(parts: list[np.ndarray]) -> list[np.ndarray]:
        i, doc, null, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((doc, null, -s, i))
        i, doc, null, s = i[order], doc[order], null[order], s[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        return [i[keep], doc[keep], null[keep], s[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count, least = 0, np.maximum(theta, 1)
        for batch in batches:
            hs, tfs = batch.column(2), batch.column(3)
            begin = hs.offsets.to_numpy().astype(np.int64)
            h, tf = hs.values.to_numpy()[begin[0] : begin[-1]], tfs.values.to_numpy()[begin[0] : begin[-1]].astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(begin))
            at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
            hit = terms[at] == h
            row, at, tf = row[hit], at[hit], tf[hit]
            n = batch.column(1).to_numpy()[row]
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))
            fresh = np.flatnonzero(np.diff(row, prepend=-1))
            ends = np.append(fresh, len(row))
            ids, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            start = 0
            while start < len(fresh):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + ENTRIES, "right")) - 1)
                a, b = ends[start], ends[stop]
                total = np.zeros((stop - start, len(items)))  # sums of integers below 2^53
                for c in range(a, b, ENTRIES):  # a very long text comes in pieces
                    d = min(b, c + ENTRIES)
                    cuts = np.maximum(ends[start:stop], c) - c if stop - start > 1 else np.zeros(1, np.int64)
                    total += np.add.reduceat(weights[at[c:d]] * impact[c:d, None].astype(np.float64), cuts, axis=0)
                r, i = np.nonzero(total >= least)
                where = row[ends[start:stop]][r]
                held.append([i, ids[where], null[where], total[r, i]])
                count += len(i)
                start = stop
                if count > 200_000:
                    held = [best(held)]
                    count = len(held[0][0])
                    last = np.searchsorted(held[0][0], np.arange(len(items)), "right") - 1
                    full = np.bincount(held[0][0], minlength=len(items)) >= k
                    least = np.where(full, np.maximum(least, held[0][3][last]), least)
        if held:
            i, doc, null, s = best(held)
            yield pa.RecordBatch.from_arrays([pa.array(items[i]), pa.array(doc, mask=null), pa.array(s.astype(np.int64))], names=["item_id", "doc_id", "score"])

    return rows.select("doc_id", "n", "hs", "tfs").mapInArrow(run, "item_id long, doc_id long, score long")


def _block(rows: DataFrame, wanted: DataFrame, terms: DataFrame, postings: DataFrame, k: int, n_docs: int, n_terms: int) -> tuple[DataFrame | None, list[int]]:
    """The best of one block of items, and how many of them the first tier, the second and all rows decided."""
    pairs = materialize(wanted.join(terms.drop("df"), "h"))
    known = pairs.toArrow()  # about BLOCK_PAIRS rows
    items = np.unique(known["item_id"].to_numpy())
    theta, proven, candidates, decided = np.zeros(len(items)), np.zeros(len(items), bool), [], []
    for tier in (1, 2):
        if proven.all():
            break
        going = pairs.where(~F.col("item_id").isin([int(x) for x in items[proven]])) if proven.any() else pairs
        rest = F.col("w") * F.col(f"r{tier}")
        sums = materialize(postings.where(F.col("tier") <= tier).join(going, "h").groupBy("item_id", "rid").agg(F.sum(F.col("w") * F.col("f")).alias("s"), F.sum(rest).alias("seen")).where("s > 0"))
        theta = np.maximum(theta, _kth(sums.groupBy("item_id", F.floor(F.log2("s") * FINE).cast("int").alias("b")).agg(F.count("*").alias("c")).collect(), items, k))
        bound = np.zeros(len(items))
        np.add.at(bound, np.searchsorted(items, known["item_id"].to_numpy()), (known["w"].to_numpy() * known[f"r{tier}"].to_numpy()).astype(np.float64))
        now = ~proven & ((bound < theta) | (bound == 0))
        decided.append(int(now.sum()))
        if now.any():
            facts = sums.sparkSession.createDataFrame([(int(items[i]), int(bound[i]), int(theta[i])) for i in np.flatnonzero(now)], "item_id long, bound long, theta long")  # a block's items
            reach = sums.join(F.broadcast(facts), "item_id").where("s + bound - seen >= theta").select("rid")
            candidates.append(reach)
        proven |= now
    out = []
    if proven.any():
        reach = candidates[0]
        for more in candidates[1:]:
            reach = reach.union(more)
        mask = bit_filter(reach.select(F.xxhash64("rid").alias("h")), "h")
        maybe = rows.select("doc_id", "n", "hs", "tfs", F.xxhash64("rid").alias("h")).mapInArrow(_only(mask), "doc_id long, n long, hs array<long>, tfs array<int>")
        out.append(_scores(maybe, items[proven], known, theta[proven], k, n_docs, n_terms))
    if not proven.all():
        out.append(_scores(rows, items[~proven], known, theta[~proven], k, n_docs, n_terms))
    found = None
    for part in out:
        found = part if found is None else found.unionByName(part)
    return found, [*decided, *[0] * (2 - len(decided)), int((~proven).sum())]


def _only(mask: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select([0, 1, 2, 3]).filter(pa.array(passing(mask, b.column(4).to_numpy())))

    return run


def rank(docs: DataFrame, items: DataFrame, *, k: int = 50, tiers: tuple[int, int] = (256, 2048), report: list | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0; all, if fewer.

    ``report`` gets, for each block of items, how many the first tier, the second and all rows decided.
    """
    wanted = materialize(item_terms(items))
    rows = materialize(term_counts(docs, bit_filter(wanted, "h")).withColumn("rid", F.monotonically_increasing_id()))
    total = rows.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    sizes = wanted.agg(F.count("*").alias("pairs"), F.count_distinct("item_id").alias("items")).first()
    blocks = max(1, -(-sizes["items"] // BLOCK_ITEMS), -(-sizes["pairs"] // BLOCK_PAIRS))
    found = None
    if total["n"]:
        terms, postings = build_tiers(rows, total["n"], total["l"], tiers)
        for b in range(blocks):
            part, decided = _block(rows, wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), terms, postings, k, total["n"], total["l"])
            if report is not None:
                report.append(decided)
            if part is not None:
                part = materialize(part)
                found = part if found is None else found.unionByName(part)
        release(postings)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
