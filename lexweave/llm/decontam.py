"""Benchmark decontamination by spaced-seed hashing.

A mask such as ``1101011011`` picks some of the words in a window and ignores the
others, so a window with substituted words still matches where the mask doesn't
look. The hashes of all masks at all places of the benchmark are joined with
those of the documents; around each hit the document's words are held against
the item's on the same diagonal, and a run with at most one substitution in five
words, of ``min_words`` words or the whole item if shorter, counts as an overlap:
of each diagonal the longest such run is taken.

The masks together meet every such run of ten words at least, wherever its
substitutions are. (A run of 26 words has a half that keeps the rule, so runs of up to
25 words decide; a test goes through all their placements.)

Documents send only windows that pass a fixed-size filter of the benchmark's
hashes (4 MB, three probes), however large the benchmark is; the join then decides,
so the filter never changes the result. Windows are merged into regions before
the shuffle, so a passage costs one row.

Items under ten words (or shorter than every mask) have masks of their own length,
each of which ignores some words, so that one of them misses all substitutions the
rule allows; items under ``least_item`` words are ignored, since so few common words
prove nothing. Null or empty texts and items match nothing. Null ids: the
row takes no part (and stays, where documents are filtered). Repeated rows give
the same overlap, once. Empty tables give no rows. Only ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import free_names, hash_words, materialize, mix64, table, text_slices

MASKS = ("1110110111", "11101001011001", "110101101011", "1110111", "11011011", "1100001111", "111111", "111100011", "110110101")
FILTER_BITS = 25
PROBES = (0, FILTER_BITS, 64 - FILTER_BITS)


def own_masks(n: int) -> list[str]:
    """Masks of ``n`` places of which one misses every choice of ``n // 5`` places."""
    wrong = n // 5
    parts = -(-n // max(1, n - 6)) if wrong == 1 else wrong + 2
    if not wrong:
        return ["1" * n]
    gone = combinations(np.array_split(np.arange(n), parts), wrong)
    return ["".join("0" if k in out else "1" for k in range(n)) for out in (set(np.concatenate(g).tolist()) for g in gone)]


def masks_of(n: int, masks: list[str]) -> list[str]:
    """The masks for an item of ``n`` words."""
    return own_masks(n) if n < max(10, min(map(len, masks))) else masks


def _seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash under ``mask`` at every start; words the mask ignores don't count."""
    n, salt = len(words) - len(mask) + 1, int(f"1{mask}", 2)
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & (1 << 64) - 1), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += words[k : k + n] * np.uint64((0xC2B2AE3D27D4EB4F + 2 * k * 0x165667B19E3779F9) & (1 << 64) - 1)
    return mix64(out)


def _benchmark(items: DataFrame, masks: list[str], least_item: int) -> tuple[DataFrame, DataFrame]:
    """(item, words as bytes, length) and (h, mask, item, ipos) of the items."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            words, first = hash_words(texts)
            spans = [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            out = pa.RecordBatch.from_arrays([part.column(0), pa.array([w.tobytes() for w in spans], pa.binary()), pa.array([len(w) for w in spans], pa.int32())], names=["item", "w", "n"])
            yield out

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = np.frombuffer(raw, np.uint64)
                for m in masks_of(len(words), masks):
                    h = _seed_hashes(words, m)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), item, np.int64)), pa.array(np.arange(len(h), dtype=np.int32))], names=["h", "item", "ipos"])

    texts = items.mapInArrow(read, "item long, w binary, n int").where(F.col("n") >= least_item).dropDuplicates(["item", "w"])
    texts = materialize(texts)
    return texts, materialize(texts.mapInArrow(seeds, "h long, item long, ipos int").distinct())


def _filter_bits(seeds: DataFrame) -> np.ndarray:
    size = 1 << FILTER_BITS
    slots = seeds.select(F.explode(F.array(*[F.pmod(F.shiftright("h", p), F.lit(size)) for p in PROBES])).alias("s")).select((F.col("s") + 1).alias("s"))
    bits = slots.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    mask = np.zeros(size // 8, np.uint8)
    for r in bits.collect():  # at most 1024 rows of 4 KB
        mask[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)[:4096]
    return mask


def longest_run(a: np.ndarray, b: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """(start, length, matches) of the longest run with at most a fifth of substitutions, if it has ``least`` words.

    Substitutions at its ends are left out as far as ``least`` words remain.
    """
    same = a == b
    total = np.concatenate(([0], np.cumsum(np.where(same, -1, 4))))  # no more at a run's end than at its start
    first = np.searchsorted(np.maximum.accumulate(total), total)
    n = np.arange(len(total)) - first
    end = int(np.argmax(n))
    start = int(first[end])
    if end - start < max(least, 1):
        return None
    while end - start > least and not same[end - 1]:
        end -= 1
    while end - start > least and not same[start]:
        start += 1
    return start, end - start, int(same[start:end].sum())


def find_overlaps(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    masks: tuple[str, ...] = MASKS,
    min_words: int = 13,
    least_item: int = 5,
    context: int = 96,
) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words, n_matches): the best overlap of each document with each item, in words."""
    masks = list(masks)
    items = items.selectExpr(f"cast(`{item_id}` as long) as item", f"`{item_text}` as text").where("item is not null")
    texts, seeds = _benchmark(items, masks, least_item)
    short = [r["n"] for r in texts.where(F.col("n") < max(10, min(map(len, masks)))).select("n").distinct().collect()]  # fewer values than a mask has places
    bits = _filter_bits(seeds)
    all_masks = list(dict.fromkeys([*masks, *(m for n in sorted(short) for m in own_masks(n))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.unpackbits(bits, bitorder="little").view(bool)
        low = np.uint64((1 << FILTER_BITS) - 1)
        for part, t in text_slices(batches, "text"):
            words, first = hash_words(t)
            found = []
            for m in all_masks:
                h = _seed_hashes(words, m)
                at = np.arange(len(h))
                for p in PROBES:
                    at = at[on[(h[at] >> np.uint64(p) & low).astype(np.int64)]]
                doc = np.searchsorted(first, at, "right") - 1
                inside = at + len(m) <= first[doc + 1]
                found.append((at[inside], h[at[inside]], doc[inside]))
            at, h, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, h, doc = at[order], h[order], doc[order]
            cuts = np.flatnonzero((np.diff(at) > context) | (np.diff(doc) != 0)) + 1
            ids = part.column(0).to_pylist()
            rows = []
            for group in np.split(np.arange(len(at)), cuts):
                d = doc[group[0]]
                a, b = max(first[d], at[group[0]] - context), min(first[d + 1], at[group[-1]] + context + max(map(len, all_masks)))
                rows.append((ids[d], int(a - first[d]), words[a:b].tobytes(), h[group].view(np.int64), (at[group] - first[d]).astype(np.int32)))
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "w", "hs", "ps"])

    docs = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").where("doc_id is not null")
    regions = materialize(docs.mapInArrow(run, "doc_id long, start int, w binary, hs array<long>, ps array<int>").withColumn("fp", F.xxhash64("w")))
    hits = regions.select("doc_id", "start", "fp", F.explode(F.arrays_zip("hs", "ps")).alias("x")).select("doc_id", "start", "fp", F.col("x.hs").alias("h"), F.col("x.ps").alias("p"))
    aligned = hits.join(seeds, "h").select("doc_id", "start", "fp", "item", (F.col("p") - F.col("ipos")).alias("diag")).distinct()
    joined = aligned.join(regions.select("doc_id", "start", "fp", "w").dropDuplicates(["doc_id", "start", "fp"]), ["doc_id", "start", "fp"]).join(texts.select("item", F.col("w").alias("iw")), "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, item, start, diag, w, iw in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                a, b = np.frombuffer(w, np.uint64), np.frombuffer(iw, np.uint64)
                d = diag - start  # the item's first word, in words of the region
                i0, i1 = max(0, -d), min(len(b), len(a) - d)
                if i1 <= i0:
                    continue
                run = longest_run(a[i0 + d : i1 + d], b[i0:i1], min(min_words, len(b)))
                if run:
                    s, n, same = run
                    rows.append((doc, item, start + d + i0 + s, i0 + s, n, same))
            kinds = [pa.int64()] * 2 + [pa.int32()] * 4
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_matches"])

    checked = joined.select("doc_id", "item", "start", "diag", "w", "iw").mapInArrow(verify, "doc_id long, item_id long, doc_start int, item_start int, n_words int, n_matches int")
    best = F.max(F.struct("n_matches", -F.col("n_words"), -F.col("doc_start"), -F.col("item_start"))).alias("b")
    out = checked.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", (-F.col("b.col3")).alias("doc_start"), (-F.col("b.col4")).alias("item_start"), (-F.col("b.col2")).alias("n_words"), F.col("b.n_matches").alias("n_matches"))


def decontaminate(docs: DataFrame, items: DataFrame, **kwargs) -> DataFrame:
    """The rows of ``docs`` that overlap no item; columns as they are, whatever their names.

    Rows without an id or text stay; rows that repeat an id go together if one of them overlaps.
    """
    (name,) = free_names(docs, "_bad")
    bad = find_overlaps(docs, items, **kwargs).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col(kwargs.get("id_col", "doc_id")) == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
