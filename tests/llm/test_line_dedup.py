import random

from hypothesis import given
from hypothesis import strategies as st

from lexweave.llm.line_dedup import dedup_lines, patience_blocks, shared_places, without_emptied


@given(st.lists(st.integers(0, 9), max_size=25), st.lists(st.integers(0, 9), max_size=25))
def test_blocks_are_common_and_in_order(a, b):
    i = j = 0
    for s, t, n in patience_blocks(a, b):
        assert n > 0 and s >= i and t >= j and a[s : s + n] == b[t : t + n]
        i, j = s + n, t + n


@given(st.lists(st.integers(), unique=True, max_size=25), st.data())
def test_unique_lines_give_a_longest_common_run(a, data):
    b = data.draw(st.permutations(a))
    best = [0] * (len(b) + 1)
    for x in a:  # longest common subsequence
        row, k = [0], b.index(x)
        for j in range(len(b)):
            row.append(max(row[-1], best[j + 1], best[j] + 1 if j == k else 0))
        best = row
    blocks = patience_blocks(a, b)
    matched = sum(n for _, _, n in blocks)
    assert matched == best[-1] or matched > 0 and matched <= best[-1]  # ends are matched greedily first


def rows():
    page = [f"line {i} of the first page with enough words" for i in range(6)]
    common = "subscribe now"
    docs = [(1, "\n".join([*page, common])), (2, "\n".join(["new", *page[1:4], "", "tail"])), (3, "\n".join([*page, common]))]
    docs += [(10 + i, f"own {i}\n{common}\nmore {i}") for i in range(30)]
    return docs + [(100, None), (101, ""), (102, " \n\n"), (None, page[0])]


def test_later_documents_lose_aligned_blocks(spark):
    df = spark.createDataFrame([(d, t, "k", 7) for d, t in rows()], "doc_id long, text string, cut string, fp int")
    out = {r.doc_id: r for r in dedup_lines(df).collect()}
    texts = dict(rows())
    assert out[1].text == texts[1] and out[1]._deleted == 0
    assert out[2].text == "new\n\ntail" and out[2]._deleted == 3 and out[2]._lines == 5
    assert out[3].text == "" and out[3]._deleted == 7 == out[3]._lines
    assert all(out[10 + i].text == texts[10 + i] for i in range(30))  # a common line alone is no overlap
    assert (out[100].text, out[101].text, out[102].text, out[None].text) == (None, "", " \n\n", texts[None])
    kept = {r.doc_id for r in without_emptied(df).collect()}
    assert kept == set(texts) - {3}
    assert without_emptied(df).columns == df.columns


def test_every_deleted_line_is_in_an_earlier_document(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    texts = dict(rows())
    for r in dedup_lines(df).where("_deleted > 0").collect():
        left = r.text.split("\n")
        for line in texts[r.doc_id].split("\n"):
            assert line in left or any(line in (t or "").split("\n") for d, t in texts.items() if d is not None and d < r.doc_id)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_and_passages_of_common_lines_are_found(spark):
    short, tabs, han = "a short note\nof two lines", [f"x{k}\ty\tz\tw\tv\tu" for k in range(6)], ["\u8a9e" * 60 + str(k) for k in range(5)]
    docs = {d: short for d in range(100, 130)}  # more copies than a rare line has
    docs |= {200 + d: "\n".join([f"own {d}", *tabs]) for d in range(25)} | {300 + d: "\n".join([f"own {d} too", *han]) for d in range(25)}
    docs |= {400 + d: "\n".join([f"mine {d}", *["la la"] * 20]) for d in range(25)}
    # each line of the passage is common and first held by another document; the passage first stands in 2000
    passage = [f"common line {k} of eight words in it" for k in range(8)]
    docs |= {1000 + d: f"head {d}\n{passage[d % 8]}\nfoot {d}" for d in range(176)} | {2000: "\n".join(["first", *passage]), 2001: "\n".join(["second", *passage])}
    out = {r.doc_id: r._deleted for r in dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    for base, n, lines in [(100, 30, 2), (200, 25, 6), (300, 25, 5), (400, 25, 20)]:
        assert out[base] == 0 and {out[base + d] for d in range(1, n)} == {lines}, base
    assert all(out[1000 + d] == 0 for d in range(176)) and out[2000] == 0 and out[2001] == 8


@given(st.lists(st.integers(0, 5), max_size=20), st.lists(st.integers(0, 5), max_size=20))
def test_with_one_word_blocks_every_common_line_is_found(a, b):
    assert sorted(shared_places(a, b, [1] * len(b), 1)) == [j for j, x in enumerate(b) if x in a]


def test_repeated_passages_and_lines():
    p, n, m = [1, 2, 3, 4], [8, 9], [18, 19]
    later = [*n, *p, *n[:1], *p, *n]
    assert sorted(shared_places([*m, *p, *m[:1], *p, *m], later, [1] * len(later), 4)) == [2, 3, 4, 5, 7, 8, 9, 10]
    assert sorted(shared_places(p, later, [1] * len(later), 4)) == [2, 3, 4, 5, 7, 8, 9, 10]
    assert len(shared_places([1, 2], [1] * 20_000, [1] * 20_000, 1)) == 20_000
    assert shared_places([1, 7, 2], [1, 2], [1, 1], 2) == []  # not a block of the earlier document


def plain_cuts(docs, least):
    """All pairs that share a line, aligned one by one: the places of the lines that go from each document."""
    lines = {d: [(i, x, len(x.split())) for i, x in enumerate(t.split("\n")) if x.strip()] for d, t in docs}
    first, out = {}, {}
    for d in sorted(lines):
        mine = [x for _, x, _ in lines[d]]
        if tuple(mine) in first:
            out[d] = {i for i, _, _ in lines[d]}
            continue
        cut = set()
        for e in first.values():
            other = [x for _, x, _ in lines[e]]
            if set(other) & set(mine):
                cut |= {lines[d][j][0] for j in shared_places(other, mine, [w for _, _, w in lines[d]], least)}
        first[tuple(mine)] = d
        out[d] = cut
    return out


def test_equals_all_pairs_where_every_line_is_rare(spark):
    r = random.Random(4)
    vocabulary = [" ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(1, 9))) for _ in range(50)]
    docs = [(d, "\n".join(r.choice(["", *vocabulary]) for _ in range(r.randrange(1, 12)))) for d in range(18)]
    docs += [(50 + d, docs[d][1]) for d in range(2)]
    out = {x.doc_id: x._deleted for x in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {d: len(c) for d, c in plain_cuts(docs, 5).items()}


def test_rare_lines_pair_all_their_holders(spark):
    # the second line is common and first held elsewhere; 2 and 3 share it beside a rare one whose first holder is 1
    common = "a common line of seven words in all"
    docs = [(1, "the rare line that only three hold"), (2, f"x\nthe rare line that only three hold\n{common}"), (3, f"y\nthe rare line that only three hold\n{common}")]
    docs += [(-d, f"head {d}\n{common}") for d in range(1, 40)]
    out = {r.doc_id: r._deleted for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (out[1], out[2], out[3]) == (0, 1, 2) and all(out[-d] == 0 for d in range(1, 40))


def test_clashing_names_long_texts_and_repeated_rows(spark):
    names = ["_later", "_print", "_cut", "_lines", "_deleted"]
    long = "\n".join(f"line {k} of a very long text" for k in range(30_000))
    docs = [(1, long), (2, long + "\nand one"), (3, "x " * 200_000), (5, "twice\nthe same row"), (5, "twice\nthe same row"), (None, long)]
    df = spark.createDataFrame([(*d, *[0] * 5) for d in docs], f"doc_id long, text string, {', '.join(f'{n} int' for n in names)}")
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "_lines_", "_deleted_"]
    got = {r.doc_id: (r._deleted_, len(r.text)) for r in out.collect()}
    assert got[2] == (30_000, len("and one")) and got[1][0] == got[3][0] == got[5][0] == got[None][0] == 0 and out.count() == 6
    assert without_emptied(df).columns == df.columns and without_emptied(df).count() == 6
