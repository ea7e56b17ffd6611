"""Line deduplication by pairwise alignment.

1. Non-blank lines are hashed. Documents with the same lines throughout are one class, for
   which the least doc_id stands; the others lose all their lines and take no further part.
2. A pair overlaps if both hold a rare line (one of at most ``rare`` classes; lines with
   the same holders are one list, so the pairs are those of at most ``rare`` members of
   each distinct list). Beyond that a document pairs with first holders: every line, and from
   each line on the shortest run of lines with ``mass_words`` words, has its least holder,
   and the pair overlaps if they share a run or lines with ``mass_words`` words
   together (repeats counted as often as both hold them). So long
   passages are found however many documents hold them, pairs never grow with the square
   of a line's holders, and a short line that half of the corpus carries is no evidence by itself.
   Words are those of the library, or one for eight characters where that is more (text without spaces).
3. Each pair is aligned with patience diff: lines that both hold once are matched,
   their longest increasing run gives anchors, anchors grow over equal neighbours,
   and the gaps between anchors are aligned in the same way. In a gap without lines
   that occur once, the k-th occurrence on one side is matched with the k-th on the other. Text that
   the later document holds again is aligned again.
4. The lines of aligned common blocks of ``min_block_words`` words or more are deleted from the later document. A line's
   first holder keeps it, so no text is lost from the corpus.

``rare`` is a number of documents, whatever the size of the table: a line of many holders is
boilerplate unless it comes with ``mass_words`` words.

Null text: no lines, returned as it is. Null doc_id: takes
no part, returned as it is. Of rows that repeat a doc_id the one with the least text
hash is deduplicated (with rows of the same text); the others stay as they are. An empty table gives an empty table. Ties can't arise, as
the least doc_id is first. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import _powers, free_names, materialize, mix64, table

SLICE_LINES = 1 << 18


def _anchors(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Positions of elements that occur once in either range, along the longest increasing run; if there are none, of equal
    elements that are the k-th of their kind on both sides."""
    ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
    at = {x: j for j, x in enumerate(b[b0:b1], b0) if cb[x] == 1 and ca.get(x) == 1}
    pairs = [(i, at[a[i]]) for i in range(a0, a1) if a[i] in at]
    if not pairs:
        places, seen = {}, Counter()
        for j in range(b0, b1):
            if b[j] in ca:
                places[b[j], seen[b[j]]] = j
                seen[b[j]] += 1
        seen = Counter()
        for i in range(a0, a1):
            j = places.get((a[i], seen[a[i]]))
            if j is not None:
                pairs.append((i, j))
            seen[a[i]] += 1
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back[k] = ends[p - 1] if p else -1
        if p == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[p], ends[p] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned common blocks as (start in a, start in b, length), in order."""
    found: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = _anchors(a, b, a0, a1, b0, b1)
        if anchors:
            i0, j0 = a0, b0
            for i, j in [*anchors, (a1, b1)]:
                if i > i0 and j > j0:
                    work.append((i0, i, j0, j))
                if i < a1:
                    found.append((i, j))
                i0, j0 = i + 1, j + 1
    blocks: list[tuple[int, int, int]] = []
    for i, j in sorted(found):
        if blocks and (blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]) == (i, j):
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def shared_places(a: list[int], b: list[int], size: list[int], least: int) -> list[int]:
    """Places in ``b`` of the aligned common blocks with ``least`` words, as often as ``b`` holds them."""
    if a == b:
        return list(range(len(b)))
    left: list = list(b)
    copies, out = 1, []
    while True:
        rest, own = Counter(x for x in left if x is not None), Counter(a)
        # of a only what b still holds; two places apart stay apart
        kept: list = []
        for x in a:
            if x in rest:
                kept.append(x)
            elif kept and kept[-1] is not ...:
                kept.append(...)
        times = max((-(-rest[x] // own[x]) for x in own if x in rest), default=0)
        blocks = patience_blocks([*kept, ...] * min(copies, times), left)
        new = [j for _, j0, n in blocks if sum(size[j0 : j0 + n]) >= least for j in range(j0, j0 + n)]
        if not new:
            return out
        out += new
        for j in new:
            left[j] = None
        copies *= 2


def _aligned(min_block_words: int):
    """Cuts per document from rows (doc_id, fp, hs, ws, ix): its own lines first, then those of its partners one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, own, cut = None, None, set()
        names, kinds = ["later", "print", "cut"], [pa.int64(), pa.int64(), pa.list_(pa.int32())]
        for batch in batches:
            rows: list[tuple] = []
            for k in range(batch.num_rows):
                this = batch.column(0)[k].as_py()
                if this != doc:
                    if cut:
                        rows.append((doc, own[0], sorted(cut)))
                    doc, own, cut = this, None, set()
                if batch.column(1)[k].is_valid:
                    own = (batch.column(1)[k].as_py(), *(batch.column(c)[k].as_py() for c in (2, 3, 4)))
                elif own is not None:
                    _, b, size, place = own
                    cut.update(place[j] for j in shared_places(batch.column(2)[k].as_py(), b, size, min_block_words))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 3, kinds, strict=True)], names=names)
        if cut:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((doc, own[0], sorted(cut)), kinds, strict=True)], names=names)

    return run


def _keys(mass_words: int):
    """(doc_id, h, w, c, line): the distinct lines of each document with words and count, and its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_LINES, "right")))
                part = batch.slice(at, stop - at)
                ids, hs, ws = part.column(0).to_numpy(), part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy().astype(np.int64)
                first = np.concatenate(([0], ends[at:stop] - (ends[at - 1] if at else 0)))
                doc = np.repeat(np.arange(len(ids)), np.diff(first))
                power, inverse = _powers(len(hs) + 1)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(hs.view(np.uint64)) * power[: len(hs)])))
                chain = lambda a, b: mix64((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64)).view(np.int64)  # noqa: B023, E731
                words = np.concatenate(([0], np.cumsum(ws)))
                a = np.arange(len(hs))
                b = np.searchsorted(words, words[:-1] + mass_words)
                a = a[(b <= first[doc + 1]) & (b > a + 1)]  # a line of so many words is evidence as it is
                every = np.concatenate((hs, chain(a, b[a]) if len(a) else np.zeros(0, np.int64)))
                owner = np.concatenate((doc, doc[a]))
                worth = np.concatenate((ws, np.full(len(a), mass_words)))
                order = np.lexsort((every, owner))
                line = (order < len(hs)).astype(bool)
                every, owner, worth = every[order], owner[order], worth[order]
                new = np.flatnonzero(np.concatenate(([True], (every[1:] != every[:-1]) | (owner[1:] != owner[:-1]))))
                count = np.diff(np.append(new, len(every)))
                columns = [pa.array(ids[owner[new]]), pa.array(every[new]), pa.array(worth[new].astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(line[new])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "w", "c", "line"])
                at = stop

    return run


FILLED = "[^\\x20\\x09-\\x0D]"


def overlapping_pairs(reps: DataFrame, rare: int, mass_words: int) -> DataFrame:
    """(doc_id, earlier) of the overlapping pairs of ``reps(doc_id, hs, ws)``."""
    each = reps.select("doc_id", "hs", "ws").mapInArrow(_keys(mass_words), "doc_id long, h long, w int, c int, line boolean")
    # written, so that the join's sides are two shuffles and a line with many holders can be split
    held = materialize(each.groupBy("h").agg(F.min(F.struct("doc_id", "c")).alias("m"), F.count("*").alias("df")).where("df > 1").select("h", "df", F.col("m.doc_id").alias("first"), F.col("m.c").alias("fc")))
    met = each.join(held, "h")
    firsts = met.where("doc_id <> first").groupBy("doc_id", F.col("first").alias("earlier")).agg(F.sum(F.col("w").cast("long") * F.least("c", "fc")).alias("words")).where(F.col("words") >= mass_words)
    few = met.where((F.col("df") <= rare) & F.col("line")).groupBy("h").agg(F.array_sort(F.collect_list("doc_id")).alias("holders")).select("holders").distinct()  # at most `rare` ids each
    later = F.transform("holders", lambda x, i: F.transform(F.slice("holders", F.lit(1), i), lambda y: F.struct(x.alias("doc_id"), y.alias("earlier"))))
    return firsts.select("doc_id", "earlier").unionByName(few.select(F.inline(F.flatten(later)))).distinct()


def duplicate_lines(docs: DataFrame, *, rare: int = 20, mass_words: int = 30, min_block_words: int = 5) -> DataFrame:
    """``docs(doc_id, text)`` → (later, print, cut): places of the lines that are to go from a document with this text hash."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.xxhash64(x).alias("h"), F.greatest(F.regexp_count(x, F.lit(f"{FILLED}+")), F.ceil(F.length(x) / 8)).cast("int").alias("w"), i.cast("int").alias("i"), x.rlike(FILLED).alias("f")))
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("fp"), F.filter(lines, lambda x: x["f"]).alias("x"))
    rows = rows.where("size(x) > 0").select("doc_id", "fp", F.col("x.h").alias("hs"), F.col("x.w").alias("ws"), F.col("x.i").alias("ix"))
    one = rows.groupBy("doc_id").agg(F.min(F.struct("fp", "hs", "ws", "ix")).alias("s")).select("doc_id", "s.*")
    arrays = materialize(one.withColumns({"k1": F.xxhash64("hs"), "k2": F.xxhash64(F.lit(1), "hs")}))
    classes = materialize(arrays.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    marked = materialize(arrays.join(classes, ["k1", "k2"], "left").select("doc_id", "fp", "hs", "ws", "ix", (F.col("first") < F.col("doc_id")).alias("copy")))
    reps = marked.where("not coalesce(copy, false)").drop("copy")
    pairs = overlapping_pairs(reps, rare, mass_words)
    # a document's own lines come once, those of its partners one at a time after them
    partners = pairs.join(reps.select(F.col("doc_id").alias("earlier"), "hs"), "earlier").select("doc_id", "hs")
    stream = reps.unionByName(partners, allowMissingColumns=True).repartition("doc_id").sortWithinPartitions("doc_id", F.col("fp").isNull())
    cuts = stream.select("doc_id", "fp", "hs", "ws", "ix").mapInArrow(_aligned(min_block_words), "later long, print long, cut array<int>")
    return cuts.unionByName(marked.where("copy").select(F.col("doc_id").alias("later"), F.col("fp").alias("print"), F.col("ix").alias("cut")))


def _joined(docs: DataFrame, id_col: str, text_col: str, **kwargs) -> tuple[DataFrame, str, str]:
    """``docs`` with shortened texts, and the names of two more columns: non-blank lines and how many were cut."""
    later, prints, cut, total, gone = free_names(docs, "_later", "_print", "_cut", "_lines", "_deleted")
    cuts = duplicate_lines(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), **kwargs).toDF(later, prints, cut)
    joined = docs.join(cuts, (F.col(id_col).cast("long") == F.col(later)) & (F.xxhash64(text_col) == F.col(prints)), "left")
    lines = F.split(F.col(text_col), "\n")
    count = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.filter(lines, lambda x: x.rlike(FILLED))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut)), lambda i: F.get(lines, i))
    short = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    columns = [short.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, count.alias(total), F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut)).alias(gone)), total, gone


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """``docs`` with the text of later documents shortened, and ``_lines``, ``_deleted``: its non-blank lines and those cut
    (with more underscores if ``docs`` has such columns)."""
    return _joined(docs, id_col, text_col, **kwargs)[0]


def without_emptied(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """``docs`` after :func:`dedup_lines`, without the documents of which every line is a duplicate. Rows with a null id or
    text, and empty texts, stay."""
    out, total, gone = _joined(docs, id_col, text_col, **kwargs)
    return out.where((F.col(gone) == 0) | (F.col(gone) < F.col(total))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_deleted").cast("long").alias("n_deleted"), "text")
