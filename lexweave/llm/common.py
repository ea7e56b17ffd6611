"""Shared helpers: durable intermediate tables, text batching and token hashing.

Words are runs of ``[^\\x20\\x09-\\x0D]``, with A-Z lower-cased (ASCII only).
Token hashes are 64-bit; every helper is deterministic across executors and
retries, so a lost task recomputes the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import materialize, release, table

__all__ = ["bit_filter", "drawn", "free_names", "hash_shingles", "hash_words", "materialize", "mix64", "passing", "release", "table", "text_slices", "top_counts", "unique_sorted"]

SLICE_BYTES = 1 << 20


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def drawn(df: DataFrame, column: str, sample: int, seed: int) -> DataFrame:
    """At most ``sample`` rows of least hash of ``column``; a bound on the hash comes first, so no task sorts rows of every partition."""
    hashed = F.xxhash64(column, F.lit(seed))
    n = df.count()
    share = 1.2 * sample / max(n, 1) + 50 / max(n, 1)
    near = df.where(hashed < F.lit(int(-(1 << 63) + share * (1 << 64)))) if share < 1 else df
    return near.orderBy(hashed, column).limit(sample)


def top_counts(counts: DataFrame, limit: int) -> pa.Table:
    """At most ``limit`` rows of ``counts(h, c)`` with the largest counts, in falling order; a bound from a histogram of counts comes first.

    Of the last counts that still fit in part those of least hash are taken.
    """
    bin_of = F.floor(F.log2("c") * 16).cast("int")
    sizes = {r["b"]: r["n"] for r in counts.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n")).collect()}  # 16 for each doubling
    room, wanted = limit, F.lit(False)
    for b in sorted(sizes, reverse=True):
        if sizes[b] <= room:
            wanted = bin_of >= b
            room -= sizes[b]
        else:
            share = 1.2 * room / sizes[b] + 50 / sizes[b]
            mixed = F.xxhash64("h", F.lit(2))
            wanted |= (bin_of == b) & (mixed < F.lit(int(-(1 << 63) + min(share, 0.999) * (1 << 64))))
            break
    return counts.where(wanted).orderBy(F.desc("c"), "h").limit(limit).toArrow()


# ---------------------------------------------------------------- batching


FILTER_BITS = 1 << 25


def bit_filter(df: DataFrame, column: str) -> np.ndarray:
    """A filter of fixed size (4 MB) over a column of 64-bit hashes, for :func:`passing`."""
    slot = F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    bits = df.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    mask = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in bits.collect():  # at most 1024 rows of 4 KB
        mask[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)[:4096]
    return mask


def passing(mask: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets pass: all that it was made of, few others."""
    s = hashes.view(np.uint64) & np.uint64(FILTER_BITS - 1)
    return (mask[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of at most ``limit`` bytes of text (or one longer row), nulls read as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            part = batch.slice(start, stop - start)
            yield part, [t or "" for t in texts.slice(start, stop - start).to_pylist()]
            start = stop


# ---------------------------------------------------------------- hashing

_MASK = (1 << 64) - 1
_STATE: dict = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _STATE.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        one = lambda b: np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64))))
        have = _STATE["powers"] = (one(np.uint64(base)), one(np.uint64(inverse)))
    return have


def _byte_tables(terms: bool) -> tuple[np.ndarray, np.ndarray]:
    if ("bytes", terms) not in _STATE:
        codes = np.arange(256)
        lower = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
        if terms:
            gap = (codes < 128) & ~((codes >= 48) & (codes <= 57) | (lower >= 97) & (lower <= 122))
        else:
            gap = (codes == 32) | ((codes >= 9) & (codes <= 13))
        value = mix64((lower + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        value[gap] = 0
        _STATE["bytes", terms] = (value, gap)
    return _STATE["bytes", terms]


def hash_words(texts: list[str], terms: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` in order, and each text's first index into them (length n + 1).

    With ``terms``, of runs of letters and digits: ASCII ones and all characters beyond ASCII.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    first = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=first[1:])
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    value, space = _byte_tables(terms)
    power, inverse = _powers(len(data) + 1)
    gap = space[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True))  # word starts and ends in turn: the data ends with a space
    starts, ends = edge[0::2], edge[1::2]
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * power[: len(data)], out=running[1:])
    words = mix64((running[ends] - running[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, first)


def hash_shingles(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words within a text, and each text's first index into them.

    A text with fewer words (but one at least) has its whole sequence as its only shingle.
    """
    total = max(len(words) - size + 1, 0)
    runs = np.zeros(total, np.uint64)
    for k in range(size):
        runs += words[k : k + total] * np.uint64((0xA24BAED4963EE407 + 2 * k * 0x9FB21C651E98DF25) & _MASK)
    runs = mix64(runs)
    if len(first) == 2 and total:
        return runs, np.array([0, total])
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begin = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(n, out=begin[1:])
    if (counts >= size).all():
        keep = np.ones(total, bool)
        for k in range(1, size):
            keep[first[1:-1] - k] = False
        return runs[keep], begin
    out = np.zeros(begin[-1], np.uint64)
    for i in range(len(counts)):
        a, c = first[i], counts[i]
        if c >= size:
            out[begin[i] : begin[i + 1]] = runs[a : a + c - size + 1]
        elif c:
            h = np.array([c], np.uint64)
            for w in words[a : a + c]:
                h = mix64(h ^ w) + np.uint64(0x632BE59BD9B4E019)
            out[begin[i]] = h[0]
    return out, begin


def unique_sorted(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x
