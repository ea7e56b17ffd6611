"""Text items: splitting, greedy packing into batches, context, and joining fragments again."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from lexweave.functions.text import estimate_tokens, hard_pieces, trim_all

MAX_CHARS, MAX_TOKENS = 2500, 600


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, text): trimmed lines that aren't empty, numbered from 0."""
    kept = F.filter(F.transform(F.split(text_col, "\n"), trim_all), lambda x: x != "")
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(kept).alias("line_no", "text"))


def greedy_runs(sizes: list[pa.ListArray], limits: list[int]) -> pa.ListArray:
    """Run of each element of lists of numbers: a new one starts where the next element would take a sum over its limit."""
    offsets = sizes[0].offsets.to_numpy()
    offsets, first = offsets - offsets[0], offsets[0]
    values = [s.values.to_numpy()[first : first + offsets[-1]].astype(np.int64) for s in sizes]
    totals = [np.concatenate(([0], np.cumsum(v))) for v in values]
    out = np.zeros(offsets[-1], np.int32)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        n = 0
        while a < b:  # one step for each run: its end is where the first of the sums passes its limit
            end = min(int(np.searchsorted(t, t[a] + limit, "right")) - 1 for t, limit in zip(totals, limits, strict=True))
            end = min(max(end, a + 1), b)
            out[a:end] = n
            a, n = end, n + 1
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))


def batch_numbers(max_chars: int = MAX_CHARS, max_tokens: int = MAX_TOKENS) -> Callable[[Column, Column], Column]:
    """Batch of each element of two arrays, characters and tokens; an item over a limit is alone."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def numbers(chars: pa.Array, tokens: pa.Array) -> pa.Array:
        return greedy_runs([chars, tokens], [max_chars, max_tokens])

    return numbers


def greedy_batches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(doc_id, line_no, text, chars, tokens, batch_no): a document's lines in greedy batches, made within its row (no shuffle)."""
    kept = F.filter(F.transform(F.split(text_col, "\n"), trim_all), lambda x: x != "")
    items = docs.select(F.col(id_col).alias("doc_id"), kept.alias("lines"))
    items = items.withColumns({"chars": F.transform("lines", lambda x: F.length(x).cast("long")), "tokens": F.transform("lines", estimate_tokens)})
    items = items.withColumn("batches", batch_numbers(**limits)(F.col("chars"), F.col("tokens")))
    each = items.select("doc_id", F.posexplode(F.arrays_zip("lines", "chars", "tokens", "batches")).alias("line_no", "x"))
    return each.select("doc_id", "line_no", F.col("x.lines").alias("text"), "x.chars", "x.tokens", F.col("x.batches").alias("batch_no"))


def batch_summary(batches: DataFrame) -> DataFrame:
    return batches.groupBy("doc_id", "batch_no").agg(F.count("*").alias("n_items"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))


def batch_context(batches: DataFrame, size: int = 700, order: str = "batch_no", within: str = "doc_id") -> DataFrame:
    """The end of the batch before and the start of the one after, and whether a chapter ends here."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    texts = batches.groupBy(within, order).agg(line.alias("batch_text"))
    w = Window.partitionBy(within).orderBy(order)
    before, after = F.right(F.lag("batch_text").over(w), F.lit(size)), F.left(F.lead("batch_text").over(w), F.lit(size))
    return texts.select(within, order, F.concat_ws("\n---\n", before, after).alias("context"), F.lead(order).over(w).isNull().alias("is_last"))


#: Where a text that is too long is cut, in this order: after paragraphs, sentences, words.
CUTS = tuple(re.compile(p, re.DOTALL) for p in (r".+?(?:\n+|\Z)", r".+?(?:[.!?…]+\s+|\Z)", r"\s*\S+\s*|\s+"))


def packed(pieces: list[str], limit: int) -> list[str]:
    """Neighbouring pieces joined while they fit; one that is too long stays whole."""
    out: list[list[str]] = []
    size = 0
    for p in pieces:
        if out and size + len(p) <= limit:
            out[-1].append(p)
            size += len(p)
        else:
            out.append([p])
            size = len(p)
    return ["".join(x) for x in out]


def cut_text(text: str, limit: int) -> list[str]:
    """Lossless pieces of at most ``limit`` characters: what doesn't fit is cut at paragraphs, then at sentences, words, anywhere."""
    chunks = [text]
    for cut in CUTS:
        chunks = [p for c in chunks for p in ([c] if len(c) <= limit else packed(cut.findall(c), limit))]
    return [c[i : i + limit] for c in chunks for i in range(0, len(c), limit)]


def split_pieces(text: Column, limit: int = MAX_TOKENS * 4) -> Column:
    @F.arrow_udf(ArrayType(StringType()))
    def pieces(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else cut_text(t, limit) for t in texts.to_pylist()], pa.list_(pa.string()))

    return pieces(text)


def split_oversized(items: DataFrame, limit: int = MAX_TOKENS * 4) -> DataFrame:
    """``items(..., text)`` with ``part``: null where the text fits, else the number of the piece."""
    long = F.length("text") > limit
    others = [c for c in items.columns if c != "text"]
    cut = items.where(long).select(*others, F.posexplode(split_pieces(F.col("text"), limit)).alias("part", "text"))  # only long texts go to Python
    return items.where(~long).select(*others, F.lit(None).cast("int").alias("part"), "text").unionByName(cut)


def hard_split(items: DataFrame, limit: int = MAX_TOKENS * 4) -> DataFrame:
    others = [c for c in items.columns if c != "text"]
    return items.select(*others, F.posexplode(hard_pieces(F.col("text"), limit)).alias("part", "text"))


def recombine(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Fragments of an item joined in order of ``part``; keys stay numbers, so 10 comes after 2."""
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("part", F.lit(0)).alias("part"), "text")))
    return fragments.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"), F.count("*").alias("n_parts"))
