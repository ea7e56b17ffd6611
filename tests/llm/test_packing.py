import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexweave.llm.packing import WordIds, pack_documents, pack_with_public_vocabulary, plan_group

ODD = ["", None, "One", "  two  spaces ", "a\n b\tc", "über naïve œuvre 漢字   x", "<|endoftext|> in text", " lead", "trail ", "x" * 5000, "it's we'll 12,345 $$$ ---", "word " * 6000, " wide", "a  b", "tab\t"]


@pytest.fixture(scope="module")
def encoders():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return Tokenizer.from_file(path), WordIds(path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 1000)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sxaé12.,-œ漢  \x85\x1c"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_equal_the_tokenizer(encoders, text):
    slow, quick = encoders
    assert quick.text_ids(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_round_trip_and_full_sequences(spark, encoders):
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(ODD * 3)], "doc_id long, text string, offset string, length int")
    rows = pack_with_public_vocabulary(docs).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in enumerate(ODD * 3):
        ids = np.array([*encoders[0].encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == own[0].sequence_tokens <= 1024 and at & (at - 1) == 0


def test_empty_table(spark):
    assert pack_with_public_vocabulary(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@given(st.lists(st.integers(0, 63), max_size=60))
def test_plan_places_everything_once(lengths):
    rows, sizes = plan_group(lengths, 64, 1.0, 0.1)
    assert sum(sizes) == sum(lengths) and all(s & (s - 1) == 0 for s in sizes)
    placed, filled = defaultdict(list), defaultdict(list)
    for piece, start, n, s, offset in rows:
        placed[piece].append((start, n))
        filled[s].append((offset, n))
    for spans, want in [(placed[i], n) for i, n in enumerate(lengths)] + [(filled[s], n) for s, n in enumerate(sizes)]:
        at = 0
        for start, n in sorted(spans):
            assert start == at and n > 0
            at += n
        assert at == want


def plain_plan(lengths, capacity, linear, quadratic):
    """Longest first to the cheapest sequence with room, by looking at every sequence."""
    total = sum(lengths)
    sizes = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if (total % capacity) >> b & 1]
    room, cost, rows = list(sizes), [0.0] * len(sizes), []
    waiting = sorted((-n, i, 0) for i, n in enumerate(lengths) if n)
    while waiting:
        n, i, start = waiting.pop(0)
        n = -n
        fits = [s for s in range(len(sizes)) if room[s] >= n] or [s for s in range(len(sizes)) if room[s]]
        s = min(fits, key=lambda s: (cost[s], s))
        m = min(n, room[s])
        rows.append((i, start, m, s, sizes[s] - room[s]))
        room[s] -= m
        cost[s] += linear * m + quadratic * m * m
        if m < n:
            waiting = sorted([*waiting, (m - n, i, start + m)])
    return rows, sizes


@settings(deadline=None)
@given(st.lists(st.integers(0, 63), max_size=80))
def test_plan_equals_plain_search(lengths):
    assert plan_group(lengths, 64, 1.0, 0.125) == plain_plan(lengths, 64, 1.0, 0.125)


def test_many_pieces_are_cut_only_where_none_has_room():
    lengths = np.random.default_rng(0).integers(1, 1024, 4096).tolist()
    rows, _ = plan_group(lengths, 1024, 1.0, 1 / 1024)
    assert len(rows) < 5250


def test_ties_repeated_rows_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "same words", 0, "a")] * 3 + [(2, "same words", 0, "b"), (None, None, 0, None)], "doc_id long, text string, sequence_id int, start string")
    rows = pack_with_public_vocabulary(docs).collect()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in {(r.doc_id, r.start, r.sequence_id, r.offset): r for r in rows}.values() if r.start == 0)
    assert {r.doc_id for r in rows} == {1, 2, None} and next(r for r in rows if r.doc_id is None).doc_tokens == 1


def test_cut_and_whole_pieces_balance_cost(spark):
    docs = spark.createDataFrame([(i, "word " * (20 * i)) for i in range(1, 60)], "doc_id long, text string").coalesce(1)
    rows = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=256).collect()
    sizes = {r.sequence_id: r.sequence_tokens for r in rows}
    costs = {r.sequence_id: r.sequence_cost for r in rows}
    full = [costs[s] for s, n in sizes.items() if n == 256]
    assert sum(sizes.values()) == sum(r.length for r in rows) and max(full) <= 256 + 256 * 256 / 1024
