"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Pieces go, in descending order of estimated cost, to the open sequence of lowest cost
that has room for them. Cost of a piece of n ids is ``linear * n + quadratic * n * n``. A document's
ids are its own, then one end id. Its runs of ``capacity`` ids are the costliest pieces and
each fill a fresh sequence; what is left of each document (shorter than ``capacity``) follows.
A piece that fits nowhere whole is cut to fill the cheapest open sequence, so all
sequences are full but for the last ids of a group of documents, which fill
sequences whose lengths are powers of two and so need no padding either.

Packing runs where the tokens are made, in groups of ``group_docs`` documents of
one partition: no shuffle, and memory bounded by the group. The result is the
same on a retry, as sequence ids come from partition and order within it.

Null text counts as empty (only the end id). Repeated rows are packed each on
their own. An empty table gives no rows. Null doc_id passes through. Only the
id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.common import table, text_slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"
#: Only words of these characters (or texts of the first 256) are left to the faster encoder of the same vocabulary.
LATIN = re.compile(r"[\x20-\x7e\n\t\u00a1-\u024f]*\Z")
UNSAFE_SPACE = re.compile(r" (?=\s|\Z)")


class WordIds(dict):
    """Ids of ``' ' + word`` as little-endian bytes, for up to ``limit`` words kept at a time.

    A piece of the vocabulary's split pattern never runs over a space that stands
    before a non-space, so a text's ids are those of its words with their spaces.
    """

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None, limit: int):
        import base64

        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.limit, self.fast, self.plain = limit, None, False
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is not None and (self.plain or LATIN.match(text)):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(" " + word)
        if len(word) <= 40:
            if len(self) >= self.limit:
                self.clear()
            self[word] = ids
        return ids

    def text_ids(self, text: str) -> np.ndarray:
        try:
            self.plain = bool(text.encode("latin-1") or 1)
        except UnicodeEncodeError:
            self.plain = False
        if any(s in text for s in self.special):
            ids = array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()
        elif UNSAFE_SPACE.search(text):
            ids = self.encode(text)
        else:
            head, *words = text.split(" ")
            ids = (self.encode(head) if head else b"") + b"".join(map(self.__getitem__, words))
        return np.frombuffer(ids, np.uint32)


class Cheapest:
    """Open sequences by free room; the cheapest with at least so much room is found in a tree over rooms."""

    def __init__(self, room: int):
        self.base = 1 << room.bit_length()
        self.held: list[list[tuple[float, int]]] = [[] for _ in range(self.base)]
        self.least: list[tuple[float, int, int] | None] = [None] * (2 * self.base)

    def _renew(self, room: int) -> None:
        own = self.held[room]
        node = room + self.base
        self.least[node] = (*own[0], room) if own else None
        while node > 1:
            node >>= 1
            left, right = self.least[2 * node], self.least[2 * node + 1]
            self.least[node] = left if right is None or left is not None and left < right else right

    def add(self, cost: float, sequence: int, room: int) -> None:
        heapq.heappush(self.held[room], (cost, sequence))
        if self.held[room][0] == (cost, sequence):
            self._renew(room)

    def take(self, need: int) -> tuple[float, int, int] | None:
        """Remove and return (cost, sequence, room) of the cheapest with room for ``need``; ties go to the smaller number."""
        node = need + self.base
        best = self.least[node]
        while node > 1:
            other = None if node & 1 else self.least[node + 1]
            if other is not None and (best is None or other < best):
                best = other
            node >>= 1
        if best is not None:
            heapq.heappop(self.held[best[2]])
            self._renew(best[2])
        return best


def plan_group(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Place pieces of the given lengths (each below ``capacity``), longest first, each where it costs least and fits.

    Returns rows (piece, start within the piece, length, sequence, offset) and each sequence's size.
    """
    total = sum(lengths)
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if (total % capacity) >> b & 1]
    waiting = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(waiting)
    open_ = Cheapest(capacity)
    for s, size in enumerate(sizes):
        open_.add(0.0, s, size)
    rows: list[tuple[int, int, int, int, int]] = []
    while waiting:
        negative, piece, start = heapq.heappop(waiting)
        need = -negative
        spent, to, room = open_.take(need) or open_.take(1)  # nowhere whole: it is cut to fill the cheapest
        n = min(need, room)
        rows.append((piece, start, n, to, sizes[to] - room))
        if n < room:
            open_.add(spent + linear * n + quadratic * n * n, to, room - n)
        if n < need:
            heapq.heappush(waiting, (n - need, piece, start + n))
    return rows, sizes


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    ranks: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 0,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    group_docs: int = 4096,
    cache_words: int = 200_000,
) -> DataFrame:
    """One row per piece; see the module's text. ``tokenizer`` is a file of the tokenizers library.

    ``ranks`` and ``pattern`` may name the same vocabulary for tiktoken, which
    then encodes plain Latin words; all else goes through ``tokenizers``.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer, ranks, pattern, cache_words)
        sequence = TaskContext.get().partitionId() << 40
        cost = lambda n: linear * n + quadratic * n * n
        rows: list[tuple] = []
        rest: list[tuple] = []

        def close() -> None:
            nonlocal sequence
            placed, sizes = plan_group([len(r[3]) for r in rest], capacity, linear, quadratic)
            spent = [0.0] * len(sizes)
            for _, _, n, s, _ in placed:
                spent[s] += cost(n)
            for piece, start, n, s, offset in placed:
                doc, before, total, ids = rest[piece]
                rows.append((doc, before + start, n, zlib.crc32(ids[start : start + n].tobytes()), total, sequence + s, offset, sizes[s], spent[s]))
            sequence += len(sizes)
            rest.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 8 + [pa.float64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            rows.clear()
            return out

        for part, texts in text_slices(batches, "text"):
            for doc, text in zip(part.column(0).to_pylist(), texts, strict=True):
                ids = np.append(words.text_ids(text), np.uint32(end_id)).astype("<u4")
                total, whole = len(ids), len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    rows.append((doc, start, capacity, zlib.crc32(ids[start : start + capacity].tobytes()), total, sequence, 0, capacity, cost(capacity)))
                    sequence += 1
                if whole < total:
                    rest.append((doc, whole, total, ids[whole:].copy()))
                if len(rest) >= group_docs:
                    close()
            if len(rows) >= 20_000:
                yield flush()
        close()
        if rows:
            yield flush()

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_with_public_vocabulary(table(spark, sf_dir, "documents"))


def pack_with_public_vocabulary(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
