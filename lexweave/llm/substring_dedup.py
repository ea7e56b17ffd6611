"""Near-duplicate passages by compact windows.

For a hash function over five-word shingles, all subsequences of a document that have
their least hash at the same place c form one compact window (l, c, r): they start in
[l, c] and end in [c, r]. l and r are the neighbours of c in the Cartesian tree
of the hashes: the nearest smaller ones. Only windows that hold a subsequence of
``min_words`` words count; there are about 2n/t of them for n shingles.

1. Windows of ``hashes`` hash functions whose least hash only one document has are left out; the rest are
   gathered by document. There an interval join over the functions gives the signatures of its subsequences of
   ``min_words`` words: the least hashes of all functions together, and of every two of them.
2. Documents that share a signature form a group, and its least document is the pivot that the others pair with, so a
   passage that many documents share gives as many pairs as documents, not their square. Groups of
   all functions come first, then those of two. A member that holds exactly
   what its pivot holds leaves; one that differs stays, as others may be nearer to it.
3. In groups of all functions with a member that its pivot doesn't explain, the runs of ``min_words`` words around all members'
   centres are compared by hash, and the first holder of a run is the pivot of the others. So no number of noisy copies
   stands between two documents that share a passage exactly.
4. In groups of two, members that their pivot doesn't explain are compared with all earlier members that are left, by the shingles
   around both centres, so a document that holds just a fragment doesn't stand between two that share more.
5. Around a shared centre both documents' shingles are compared, the passage
   grows as far as Jaccard 0.8 allows, and is kept if its shingle sets reach
   ``percent`` and it has ``min_words`` words.

An exact passage shares all its signatures and a run, and is found. A near one of Jaccard J shares a signature of two of four functions with
probability 1 - (1-J)^4 - 4 J (1-J)^3 for each of its windows (0.97 at 0.8). How many earlier documents
hold the centres without the passage doesn't matter; tests measure both.

The earliest holder of a passage is never reported as a copy; each later one is, with its
source. Null and empty texts and texts under ``min_words`` words have no passage. Null doc_id:
no part. Of rows that repeat a doc_id one text counts (the one of the least hash). An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import _powers, bit_filter, hash_shingles, hash_words, materialize, mix64, passing, release, table, text_slices, unique_sorted

SIZE = 5
CHUNK = 64
PACK = 32, 256  #: open members, and all members, of a group that are compared at once


def compact_windows(h: np.ndarray, t: int, reach: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows of at least ``t`` places; zeros in ``h`` part the documents.

    Of equal hashes in a window the first is its centre. With ``reach`` (``t`` at least) l and r may be cut off at that many places from c.
    """
    reach = len(h) if reach is None else reach
    if len(h) < t:
        return (np.zeros(0, np.int64),) * 3
    levels = [h]  # levels[k][i]: the least of h[i : i + 2**k]
    while 1 << len(levels) <= min(reach, len(h)):
        prev, w = levels[-1], 1 << len(levels) - 1
        levels.append(np.minimum(prev[:-w], prev[w:]))
    k = t.bit_length() - 1
    least = np.minimum(levels[k][: len(h) - t + 1], levels[k][t - (1 << k) :][: len(h) - t + 1])
    # the greatest of the least values of the length-t runs around each place
    padded = np.concatenate((np.zeros(t - 1, np.uint64), least, np.zeros(t - 1, np.uint64)))
    width = 1
    while 2 * width <= t:
        padded = np.maximum(padded[:-width], padded[width:])
        width *= 2
    if width < t:
        padded = np.maximum(padded[: len(padded) - (t - width)], padded[t - width :])
    c = np.flatnonzero((padded[: len(h)] == h) & (h > 0))
    v = h[c]
    left, right = c.copy(), c.copy()
    for k in range(len(levels) - 1, -1, -1):
        w, m = 1 << k, levels[k]
        ok = left - w >= 0
        ok[ok] = m[left[ok] - w] > v[ok]
        left[ok] -= w
        ok = right + w < len(h)
        ok[ok] = m[right[ok] + 1] >= v[ok]
        right[ok] += w
    big = right - left + 1 >= t
    return left[big], c[big], right[big]


def _windows(hashes: int, t: int):
    """Windows as (v, doc_id, w): least hash, document, and in one number the centre, the first start of a subsequence of
    ``t`` places that belongs to it (as places before the centre), how many more starts there are, and the function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            runs, begin = hash_shingles(*hash_words(texts), SIZE)
            n = np.diff(begin)
            long = np.flatnonzero(n >= t)
            if not len(long):
                continue
            inside = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in long])
            sizes = n[long]
            starts = np.concatenate(([0], np.cumsum(sizes + 1)))
            at = np.arange(len(inside)) + np.repeat(np.arange(len(long)), sizes)
            ids = part.column(0).to_numpy()[long]
            out = []
            for f in range(hashes):
                h = np.zeros(starts[-1], np.uint64)
                h[at] = mix64(runs[inside] ^ np.uint64(0x9E3779B97F4A7C15 * (f + 1) & (1 << 64) - 1)) | np.uint64(1)
                l, c, r = compact_windows(h, t, t)
                doc = np.searchsorted(starts, c, "right") - 1
                place = c - starts[doc]
                # a hash that comes again within t places stands for itself once, with its widest window
                order = np.lexsort((c, h[c]))
                x, y = order[:-1], order[1:]
                again = doc[x[(h[c[x]] == h[c[y]]) & (doc[x] == doc[y]) & (place[x] // t == place[y] // t)]]
                if len(again):  # whole windows of these documents
                    whole = np.zeros(len(sizes), bool)
                    whole[again] = True
                    kept, own = ~whole[doc], np.flatnonzero(np.repeat(whole, sizes + 1))
                    l, c, r = (np.concatenate((a[kept], own[b])) for a, b in zip((l, c, r), compact_windows(h[own], t), strict=True))
                    doc = np.searchsorted(starts, c, "right") - 1
                    place = c - starts[doc]
                    order = np.lexsort((c, l - r, place // t, h[c], doc))
                    l, c, r, doc, place = (x[order] for x in (l, c, r, doc, place))
                    fresh = np.ones(len(c), bool)
                    fresh[1:] = (doc[1:] != doc[:-1]) | (h[c][1:] != h[c][:-1]) | (place[1:] // t != place[:-1] // t)
                    l, c, r, doc, place = (x[fresh] for x in (l, c, r, doc, place))
                first, last = np.maximum(l, c - t + 1), np.minimum(c, r - t + 1)
                out.append((h[c].view(np.int64), ids[doc], place << 32 | c - first << 18 | last - first << 4 | f))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["v", "doc_id", "w"])

    return run


def signatures(v: np.ndarray, w: np.ndarray, doc: np.ndarray, hashes: int, t: int, groups: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, centre, document) of the distinct signatures of each document's subsequences, for each of the ``groups`` of functions.

    ``doc`` numbers the documents of the windows in rising order; they are laid one behind another, so all are done at once.
    """
    f, c = w & 15, w >> 32
    start = c - (w >> 18 & 0x3FFF)
    end = start + (w >> 4 & 0x3FFF)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    size = np.maximum.reduceat(c, first) + 2
    base = np.concatenate(([0], np.cumsum(size)[:-1]))
    shift = np.repeat(base, np.diff(first, append=len(doc)))
    start, end, c = start + shift, end + shift, c + shift
    cuts = np.unique(np.concatenate((start, end + 1)))
    on, val, mid = [], [], []
    for k in range(hashes):  # a function's windows have no start in common
        own = np.flatnonzero(f == k)
        if not len(own):
            on.append(np.zeros(len(cuts), bool))
            val.append(None)
            mid.append(None)
            continue
        own = own[np.argsort(start[own], kind="stable")]
        at = own[np.maximum(np.searchsorted(start[own], cuts, "right") - 1, 0)]
        on.append((start[at] <= cuts) & (cuts <= end[at]))
        val.append(v[at].view(np.uint64))
        mid.append(c[at])
    keys, centres = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for g in groups:
        both = np.flatnonzero(np.logical_and.reduce([on[k] for k in g]))
        if not len(both):
            continue
        key = np.full(len(both), sum(1 << k for k in g), np.uint64)
        for k in g:
            key = mix64(key ^ val[k][both]) + np.uint64(0x632BE59BD9B4E019)
        keys.append(key)
        centres.append(mid[g[0]][both])
    key, centre = np.concatenate(keys), np.concatenate(centres)
    order = np.lexsort((centre, key))  # by key, document and centre
    key, centre = key[order], centre[order]
    whose = np.searchsorted(base, centre, "right") - 1
    centre -= base[whose]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (whose[1:] != whose[:-1]) | (centre[1:] // t != centre[:-1] // t)
    return key[fresh].view(np.int64), centre[fresh], doc[first][whose[fresh]]


def inside(at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which places lie in one of the spans from ``a`` to before ``b``."""
    return np.searchsorted(np.sort(a), at, "right") > np.searchsorted(np.sort(b), at, "right")


def _signed(hashes: int, t: int, groups: list[tuple[int, ...]]):
    """(key, doc_id, c, done) from (doc_id, vs, ws, spans); what an exact passage covers is left out, what another covers is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy())
            start = 0
            while start < batch.num_rows:  # documents of about 50,000 windows at once
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 50_000, "right")))
                part = batch.slice(start, stop - start)
                start = stop
                ids, vs, ws, spans = part.columns
                doc = np.repeat(np.arange(part.num_rows), vs.value_lengths().to_numpy())
                key, c, doc = signatures(vs.flatten().to_numpy(), ws.flatten().to_numpy(), doc, hashes, t, groups)
                lengths = spans.value_lengths().fill_null(0).to_numpy()
                a, b, exact = (x.to_numpy(zero_copy_only=False) for x in spans.flatten().flatten())
                behind = np.repeat(np.arange(part.num_rows), lengths) << 32
                a, b, at, exact = behind + a, behind + b, doc << 32 | c, exact.astype(bool)
                left = ~inside(at, a[exact], b[exact])
                done = inside(at, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(key[left]), pa.array(ids.to_numpy()[doc[left]]), pa.array(c[left].astype(np.int32)), pa.array(done[left])], names=["key", "doc_id", "c", "done"])

    return run


def _runs(words: np.ndarray) -> np.ndarray:
    return hash_shingles(words.astype(np.uint64), np.array([0, len(words)]), SIZE)[0]


class Held:
    """A text's shingles, ready to be looked up by value and nearest place."""

    def __init__(self, a: np.ndarray):
        self.a, self.n = a, len(a) + 1
        self.order = np.argsort(a, kind="stable")
        s = a[self.order]
        new = np.concatenate(([True], s[1:] != s[:-1]))
        self.values, self.first = s[new], np.append(np.flatnonzero(new), len(a))
        ranks = np.cumsum(new) - 1
        self.keys = ranks * self.n + self.order  # grows with value, then place
        self.rank = np.empty(len(a), np.int64)
        self.rank[self.order] = ranks


class Met:
    """Where a later text's shingles stand in a held one: ranks of their values there, -1 if none, and places of those that are there."""

    def __init__(self, held: Held, b: np.ndarray):
        self.held, self.b = held, b
        self.rank = np.minimum(np.searchsorted(held.values, b), len(held.values) - 1)
        self.rank[held.values[self.rank] != b] = -1
        self.hits = np.flatnonzero(self.rank >= 0)
        own = self.rank[self.hits]
        lo, hi = held.first[own], held.first[own + 1]
        self.found = held.order[lo]
        self.many = np.flatnonzero(hi - lo > 1)  # several places to choose from
        self.own, self.lo, self.hi = own[self.many], lo[self.many], hi[self.many]

    def places(self, off: int) -> np.ndarray:
        """Place of each hit in the held text, nearest to the diagonal ``off`` places on."""
        if not len(self.many):
            return self.found
        held, found = self.held, self.found.copy()
        expected = self.hits[self.many] + off
        k = np.searchsorted(held.keys, self.own * held.n + np.clip(expected, 0, held.n - 1))
        after, before = (held.order[np.clip(x, self.lo, self.hi - 1)] for x in (k, k - 1))
        found[self.many] = np.where(np.abs(after - expected) < np.abs(before - expected), after, before)
        return found

    def likeness(self, a0: int, a1: int, b0: int, b1: int) -> float:
        x, y = (np.zeros(len(self.held.values), bool) for _ in range(2))
        x[self.held.rank[a0:a1]] = True
        rank = self.rank[b0:b1]
        y[rank[rank >= 0]] = True
        other = self.b[b0:b1][rank < 0]
        common = np.count_nonzero(x & y)
        return common / (np.count_nonzero(x) + np.count_nonzero(y) + len(np.unique(other)) - common)


def grow(met: Met, at: int, pb: int, percent: int, need: int = 1, band: int = 48) -> tuple[int, int, int, int, float] | None:
    """The best passage around equal shingles, the held text's at ``at`` and the other's at ``pb``: (a start, a end, b start, b end, Jaccard) in shingles.

    None if fewer than ``need`` shingles are near the diagonal: no run of the places that ask for so many can pass then.
    """
    # where each shingle of b stands in a, nearest to the diagonal
    found = met.places(at - pb)
    same = np.abs(found - met.hits - (at - pb)) <= band
    hits, found = met.hits[same], found[same]
    k = np.searchsorted(hits, pb)
    if len(hits) < need or k == len(hits) or hits[k] != pb:
        return None
    # Jaccard 0.8 is 8 of 9 shingles of either side: one that differs for eight that don't; so no run is longer than what all hits allow
    most = len(hits) * (100 + percent) // (2 * percent) + 1 if percent else len(met.b)
    low, high = max(0, pb - most), min(len(met.b), pb + most + 1)
    gain = np.full(high - low, -2 * percent)
    gain[hits[np.searchsorted(hits, low) : np.searchsorted(hits, high)] - low] = 100 - percent
    total = np.concatenate(([0], np.cumsum(gain)))
    q = pb - low
    # the longest run around pb that isn't below zero, else the one of the greatest sum
    best = np.maximum.accumulate(total[:q:-1])[::-1]  # from each end on, ends being pb + 1, ...
    reach = len(best) - np.searchsorted(best[::-1], total[: q + 1], "left")  # how many ends have enough further on
    start = int(np.where(reach > 0, q + reach - np.arange(q + 1), 0).argmax())
    longest = (start, q + int(reach[start]))
    richest = (int(total[: q + 1].argmin()), q + 1 + int(total[q + 1 :].argmax()))
    for b0, b1 in dict.fromkeys((longest, richest)):
        i, j = np.searchsorted(hits, (low + b0, low + b1))
        b0, b1 = int(hits[i]), int(hits[j - 1]) + 1
        a0, a1 = int(found[i:j].min()), int(found[i:j].max()) + 1
        likeness = met.likeness(a0, a1, b0, b1)
        if likeness * 100 >= percent:
            break
    return a0, a1, b0, b1, likeness


def _verified(percent: int, t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # pairs come by source
        need = -(-2 * percent * t // (100 + percent))  # common shingles of two passages of t places
        for batch in batches:
            rows = []
            ends = np.cumsum(batch.column(2).value_lengths().to_numpy()).tolist()
            c, pc = (x.to_pylist() for x in batch.column(2).flatten().flatten())
            for k, (doc, other) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if other != last:
                    last, held = other, Held(_runs(np.frombuffer(batch.column(4)[k].as_py(), np.uint32)))
                met = Met(held, _runs(np.frombuffer(batch.column(3)[k].as_py(), np.uint32)))
                if len(met.hits) < need:
                    continue
                done: list[tuple[int, int]] = []
                own: list[tuple] = []
                for x, y in sorted(zip(c[ends[k - 1] if k else 0 : ends[k]], pc[ends[k - 1] if k else 0 : ends[k]], strict=True)):
                    if any(s <= x < e for s, e in done) or x >= len(met.b) or y >= len(held.a):
                        continue
                    got = grow(met, y, x, percent, need)
                    if got and got[3] - got[2] >= t and got[1] - got[0] >= t and got[4] * 100 >= percent:
                        done.append((got[2], got[3]))
                        own.append((doc, got[2], got[3] + SIZE - 1, other, got[0], got[1] + SIZE - 1, got[4]))
                own.sort(key=lambda x: (x[1] - x[2], x[1]))
                rows += [x for i, x in enumerate(own) if not any(y[1] <= x[1] and x[2] <= y[2] for y in own[:i])]  # not those inside a longer one
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=NAMES)

    return run


SCHEMA = "doc_id long, start_word int, end_word int, source_id long, source_start int, source_end int, similarity double"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``df(doc_id, ...)`` whose document may be in ``ids(doc_id)``: a filter of fixed size, before anything is shuffled."""
    mask = bit_filter(ids.select(F.xxhash64("doc_id").alias("h")), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(list(range(b.num_columns - 1))).filter(pa.array(passing(mask, b.column(b.num_columns - 1).to_numpy())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.withColumn("_h", F.xxhash64("doc_id")).mapInArrow(run, schema)


def _all_words(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, w): 32-bit word hashes of the documents in ``ids(doc_id)``, of one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            words, first = hash_words(texts)
            w = [words[a:b].astype(np.uint32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(w, pa.binary())], names=["doc_id", "fp", "w"])

    made = _among(docs.select("doc_id", "text", "fp"), ids).mapInArrow(run, "doc_id long, fp long, w binary")
    return made.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("fp", "w")).alias("m")).select("doc_id", "m.w")


def _words_of(words: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``words(doc_id, w)`` for ``ids(doc_id)``."""
    return _among(words, ids).join(ids, "doc_id", "left_semi")


def _verify(held: DataFrame, pairs: DataFrame, percent: int, t: int) -> DataFrame:
    """Passages of ``pairs(doc_id, other, places)``; a source's pairs are dealt in chunks, so a hot one is many tasks' work."""
    ids = pairs.select("doc_id").union(pairs.select("other")).distinct()
    written = materialize(_words_of(held, ids))
    words = written.select("doc_id", "w")
    parts = materialize(pairs.groupBy("other").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n")))
    sources = words.join(parts.withColumnRenamed("other", "doc_id"), "doc_id").select(F.col("doc_id").alias("other"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), F.col("w").alias("pw"))
    dealt = pairs.join(parts, "other").withColumn("part", F.pmod(F.xxhash64("doc_id"), "n").cast("int"))
    joined = dealt.join(words, "doc_id").join(sources, ["other", "part"])
    out = materialize(joined.select("doc_id", "other", "places", "w", "pw").mapInArrow(_verified(percent, t), SCHEMA))
    release(written, parts)
    return out


def _spans(found: DataFrame) -> DataFrame:
    """(doc_id, spans): the shingles of found passages, and whether they are exactly the source's."""
    span = F.struct(F.col("start_word").alias("a"), (F.col("end_word") - (SIZE - 1)).alias("b"), (F.col("similarity") == 1.0).alias("exact"))
    return found.groupBy("doc_id").agg(F.collect_set(span).alias("spans"))  # bounded by one document's passages


def _pass(signed: DataFrame, held: DataFrame, percent: int, t: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Passages that members of a group have from their pivot, and the groups that are left without it."""
    pivots = signed.groupBy("key").agg(F.min(F.struct("doc_id", "c")).alias("p"), F.max("doc_id").alias("z")).where("z > p.doc_id")
    pivots = materialize(pivots.select("key", F.col("p.doc_id").alias("other"), F.col("p.c").alias("pc")))
    met = signed.join(pivots, "key").where("doc_id > other")
    met = met if last else materialize(met)
    if not last:
        release(signed)
    pairs = met.where("not done").groupBy("doc_id", "other").agg(F.collect_set(F.struct("c", "pc")).alias("places"))  # bounded by one document's windows
    pairs = materialize(pairs)
    found = _verify(held, pairs, percent, t)
    release(pairs)
    if last:
        release(pivots)
        return found, None
    within = lambda x: (F.col("c") >= x["a"]) & (F.col("c") < x["b"])
    left = met.join(_spans(found), "doc_id", "left").where(~F.coalesce(F.exists("spans", lambda x: within(x) & x["exact"]), F.lit(False)))
    left = materialize(left.select("key", "doc_id", "c", (F.col("done") | F.coalesce(F.exists("spans", within), F.lit(False))).alias("done")))
    release(met, pivots)
    return found, left


def _runs_around(t: int):
    """(h, doc_id, s, open): hashes of every run of ``t`` shingles around the given centres of (doc_id, w, cs), and whether one of these is open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a = _runs(np.frombuffer(batch.column(1)[k].as_py(), np.uint32))
                last = len(a) - t
                if last < 0:
                    continue
                near = np.zeros((2, last + 2), np.int64)
                for x in batch.column(2)[k].as_py():
                    for row in range(2 if x["open"] else 1):
                        near[row, min(max(x["c"] - t + 1, 0), last + 1)] += 1
                        near[row, min(x["c"], last) + 1] -= 1
                covered = near.cumsum(1)[:, : last + 1] > 0
                starts = np.flatnonzero(covered[0])
                power, inverse = _powers(len(a))
                sums = np.concatenate(([np.uint64(0)], np.cumsum(mix64(a) * power[: len(a)])))
                for i in range(0, len(starts), 50_000):
                    own = starts[i : i + 50_000]
                    h = (sums[own + t] - sums[own]) * inverse[own]
                    yield pa.RecordBatch.from_arrays([pa.array(mix64(h).view(np.int64)), pa.array(np.full(len(own), batch.column(0)[k].as_py(), np.int64)), pa.array(own.astype(np.int32)), pa.array(covered[1][own])], names=["h", "doc_id", "s", "open"])

    return run


def _exact(signed: DataFrame, found: DataFrame, held: DataFrame, percent: int, t: int) -> DataFrame:
    """Passages of members that the least document of their group doesn't explain, by the runs themselves.

    An exact passage has a run of ``t`` shingles in common, and so its signature. In every group with a member that is still open, all
    members' runs around their centres are compared by hash: the first holder of a run is the pivot of all others, however many
    holders of something else stand between them. Linear in the members, and complete for exact passages.
    """
    within = lambda x: (F.col("c") >= x["a"]) & (F.col("c") < x["b"])
    least = materialize(signed.groupBy("key").agg(F.min("doc_id").alias("other"), F.max("doc_id").alias("z")).where("z > other").select("key", "other"))
    met = materialize(signed.join(least, "key").join(_spans(found), "doc_id", "left").select("key", "doc_id", "c", ((F.col("doc_id") > F.col("other")) & ~F.coalesce(F.exists("spans", within), F.lit(False))).alias("open")))
    keys = materialize(met.groupBy("key").agg(F.bool_or("open").alias("o")).where("o").select("key"))
    members = met.join(keys, "key").groupBy("doc_id", "c").agg(F.bool_or("open").alias("open")).groupBy("doc_id").agg(F.collect_list(F.struct("c", "open")).alias("cs"))  # bounded by one document's windows
    members = materialize(members)
    words = _words_of(held, members.select("doc_id")).join(members, "doc_id").select("doc_id", "w", "cs")
    runs = materialize(words.mapInArrow(_runs_around(t), "h long, doc_id long, s int, open boolean"))
    release(least, met, keys)
    first = materialize(runs.groupBy("h").agg(F.min(F.struct("doc_id", "s")).alias("p"), F.max("doc_id").alias("z")).where("z > p.doc_id").select("h", F.col("p.doc_id").alias("other"), F.col("p.s").alias("pc")))
    # of runs that follow each other in both documents the first is enough, and one of every t beside it
    ties = runs.where("open").join(first, "h").where("doc_id > other").groupBy("doc_id", "other", (F.col("s") - F.col("pc")).alias("d"), F.floor(F.col("s") / t).alias("g")).agg(F.min(F.struct(F.col("s").alias("c"), "pc")).alias("x"))
    pairs = materialize(ties.groupBy("doc_id", "other").agg(F.collect_list("x").alias("places")))
    out = _verify(held, pairs, percent, t)
    release(members, runs, first, pairs)
    return out


def _around(t: int):
    """(key, doc_id, c, open, w): for each centre of (doc_id, w, cs) the shingles fewer than ``t`` places from it, as 32-bit hashes, and how many stand before it."""
    names = ["key", "doc_id", "c", "open", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a = _runs(np.frombuffer(batch.column(1)[k].as_py(), np.uint32)).astype(np.uint32)
                cs = batch.column(2)[k].values
                for i in range(0, len(cs), 10_000):
                    key, c, free = (x.to_numpy(zero_copy_only=False) for x in cs.slice(i, 10_000).flatten())
                    w = pa.array([a[max(x - t + 1, 0) : x + t].tobytes() for x in c.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(c), batch.column(0)[k].as_py(), np.int64)), pa.array(c), pa.array(free), w], names=names)

    return run


def near_centres(b: list[bytes], a: list[bytes], t: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``b`` have ``need`` shingles of one of ``a`` within some ``t`` places: (indices into b, indices into a). All are 32-bit hashes."""
    return _near_in_groups(*((*_hashes(x), np.array([len(x)])) for x in (b, a)), t, need)


def _hashes(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All 32-bit hashes, and how many each row has."""
    return np.frombuffer(b"".join(rows), np.uint32), np.array([len(x) // 4 for x in rows])


def _near_in_groups(b: tuple, a: tuple, t: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`near_centres` for several groups at once, fewer than 4,096; each side as all hashes, their number for each member, and the members of each group."""
    (flat, size, nb), (theirs, their_size, na) = b, a
    start_b, start_a = np.cumsum(nb) - nb, np.cumsum(na) - na
    groups = np.arange(len(nb), dtype=np.uint64)
    whose = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    group_b, group_a = np.repeat(groups, nb), np.repeat(groups, na)
    member = np.arange(len(their_size)) - np.repeat(start_a, na)  # within its group: of a pack, so far below 2**20
    own = unique_sorted(np.repeat(group_a << np.uint64(52) | member.astype(np.uint64), their_size) | theirs.astype(np.uint64) << np.uint64(20))
    value, holder = own >> np.uint64(20), (own & np.uint64((1 << 20) - 1)).astype(np.int64)
    wanted = group_b[whose] << np.uint64(32) | flat
    lo = np.searchsorted(value, wanted, "left")
    n = np.searchsorted(value, wanted, "right") - lo
    hit = np.repeat(np.arange(len(flat)), n)  # at most one for each place and member of a
    # pairs are numbered by group, member of b and member of a
    first = np.cumsum(nb * na) - nb * na
    mine = whose[hit]
    g = group_b[mine].astype(np.int64)
    pair = first[g] + (mine - start_b[g]) * na[g] + holder[np.arange(len(hit)) + np.repeat(lo - np.cumsum(n) + n, n)]
    counts = np.bincount(pair, minlength=int((nb * na).sum()))
    some = np.flatnonzero(counts >= need)
    if not len(some):
        return some, some
    kept = counts[pair] >= need
    total = np.zeros((len(some), int(size.max()) + 1), np.int32)
    total[np.searchsorted(some, pair[kept]), place[hit[kept]] + 1] = 1
    total = total.cumsum(1)
    wide = min(t, total.shape[1] - 1)
    some = some[(total[:, wide:] - total[:, :-wide]).max(1) >= need]
    g = np.searchsorted(first, some, "right") - 1
    some = some - first[g]
    return start_b[g] + some // na[g], start_a[g] + some % na[g]


def _apart(percent: int, t: int):
    """(doc_id, other, c, pc): open members of (opens, all) with an earlier one that is near them around the centres."""
    need = -(-2 * percent * t // (100 + percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [x.value_lengths().to_numpy().astype(np.int64) for x in batch.columns]
            ends = np.cumsum(counts[0] * counts[1])
            start = 0
            while start < batch.num_rows:  # packs of about two full pairs' work at once
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 2 * PACK[0] * PACK[1], "right")))
                stop = min(stop, start + 4095)
                (doc, c, b), (other, pc, a) = (x.slice(start, stop - start).flatten().flatten() for x in batch.columns)
                i, j = _near_in_groups((*_hashes(b.to_pylist()), counts[0][start:stop]), (*_hashes(a.to_pylist()), counts[1][start:stop]), t, need)
                start = stop
                doc, c, other, pc = doc.to_numpy()[i], c.to_numpy()[i], other.to_numpy()[j], pc.to_numpy()[j]
                late = other < doc
                yield pa.RecordBatch.from_arrays([pa.array(x[late]) for x in (doc, other, c, pc)], names=["doc_id", "other", "c", "pc"])

    return run


def _closing(left: DataFrame, held: DataFrame, percent: int, t: int) -> DataFrame:
    """Passages of the members that no pivot explains, from any earlier member of their groups.

    All that are still open are compared with all earlier members, by the shingles around both centres; members that are the
    same there are one. What has enough of them in common is verified. Quadratic in the members of a group, but only for open ones: both
    sides are dealt in packs of a fixed size, so a large group is many tasks, and no task holds more than two packs.
    """
    groups = materialize(left.groupBy("key").agg(F.min("doc_id").alias("a"), F.max(F.when(~F.col("done"), F.col("doc_id"))).alias("z")).where("z > a").select("key", "z"))
    live = left.join(groups, "key").where("doc_id <= z").select("doc_id", F.struct("key", "c", (~F.col("done")).alias("open")).alias("x"))
    members = materialize(live.groupBy("doc_id").agg(F.collect_list("x").alias("cs")))  # bounded by one document's windows
    around = materialize(_words_of(held, members.select("doc_id")).join(members, "doc_id").select("doc_id", "w", "cs").mapInArrow(_around(t), "key long, doc_id long, c int, open boolean, w binary"))
    one = F.struct("doc_id", "c", "w")
    first = materialize(around.groupBy("key", F.xxhash64("w").alias("h")).agg(F.min(one).alias("x")).select("key", "x"))
    packs = lambda rows, size, name: rows.groupBy("key").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = materialize(packs(around.where("open"), PACK[0], "m").join(packs(first, PACK[1], "n"), "key"))

    def packed(rows: DataFrame, n: str, name: str) -> DataFrame:
        dealt = rows.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("x.doc_id", "x.c"), n))
        return materialize(dealt.groupBy("key", "part").agg(F.collect_list("x").alias(name), F.first("n").alias("n")))  # about a pack's members

    opens, others = packed(around.where("open").select("key", one.alias("x")), "m", "opens"), packed(first, "n", "others")
    release(first, sizes)
    # the packs of a key meet by part, so those of a large group aren't one task's work
    near = opens.select("key", "opens", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part")).join(others.drop("n"), ["key", "part"])
    near = near.select("opens", "others").mapInArrow(_apart(percent, t), "doc_id long, other long, c int, pc int")
    pairs = materialize(near.groupBy("doc_id", "other").agg(F.collect_set(F.struct("c", "pc")).alias("places")))  # bounded by one document's windows
    out = _verify(held, pairs, percent, t)
    release(groups, members, around, opens, others, pairs)
    return out


def find_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, percent: int = 80, hashes: int = 4) -> DataFrame:
    """(doc_id, start_word, end_word, source_id, source_start, source_end, similarity): passages of a document that an earlier one holds; ends are exclusive."""
    t = min_words - SIZE + 1
    if not (0 < t < 1 << 14 and 1 < hashes <= 16):
        raise ValueError("min_words must be from 5 to 16387, hashes from 2 to 16")
    docs = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").where("doc_id is not null and text is not null").withColumn("fp", F.xxhash64("text"))
    windows = materialize(docs.select("doc_id", "text").mapInArrow(_windows(hashes, t), "v long, doc_id long, w long"))
    # written, so that the join's sides are two shuffles and a hash that many documents have can be split
    shared = materialize(windows.groupBy("v").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("v"))
    live = windows.join(shared, "v")
    each = materialize(live.groupBy("doc_id").agg(F.collect_list(F.struct("v", "w")).alias("x")).select("doc_id", F.col("x.v").alias("vs"), F.col("x.w").alias("ws")))  # bounded by one document's windows
    release(windows, shared)
    held = materialize(_all_words(docs, each.select("doc_id")))  # texts are read once more, and not again
    schema = "key long, doc_id long, c int, done boolean"
    none = F.lit(None).cast("array<struct<a:int,b:int,exact:boolean>>").alias("spans")
    every = each.select("doc_id", "vs", "ws", none).mapInArrow(_signed(hashes, t, [tuple(range(hashes))]), schema)
    every = materialize(every)
    found, _ = _pass(every, held, percent, t, True)
    found = found.unionByName(_exact(every, found, held, percent, t))
    release(every)
    twos = [(f, g) for f in range(hashes) for g in range(f + 1, hashes)]
    left = materialize(each.join(_spans(found), "doc_id", "left").select("doc_id", "vs", "ws", "spans").mapInArrow(_signed(hashes, t, twos), schema))
    release(each)
    more, left = _pass(left, held, percent, t, False)
    found = found.unionByName(more).unionByName(_closing(left, held, percent, t))
    release(left, held)
    return found.distinct()


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without_passages(docs: DataFrame, **kwargs) -> DataFrame:
    """``docs(doc_id, text)`` with the found passages cut from later documents."""
    spans = find_passages(docs, **kwargs).groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if own:
                    at = [m.span() for m in WORD.finditer(text)]
                    kept, end = [], 0
                    for s, e in sorted((x["start_word"], x["end_word"]) for x in own):
                        if e > end:
                            kept.append(text[at[end - 1][1] if end else 0 : at[max(s, end)][0]] if s > end else "")
                            end = e
                    text = "".join([*kept, text[at[end - 1][1] :]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").join(spans, "doc_id", "left").mapInArrow(cut, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents"))
