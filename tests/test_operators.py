"""Operators on literal rows."""

import io
import random
import re
import time
import zipfile

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import archive, budget, catalog, jobs, layout, links, memory, readinglog, segment
from lexweave.operators.order import parted
from lexweave.plans.pages import document_sections
from lexweave.plans.translate import translate_items
from lexweave.session import BATCH, materialize
from lexweave.sources import archives, files


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def batches(spark, *tokens):
    df = spark.createDataFrame([([t * 4 for t in tokens], list(tokens))], "c array<long>, t array<long>")
    return df.select(segment.batch_numbers()(F.col("c"), F.col("t")).alias("x")).first()["x"]


def test_greedy_batches(spark):
    assert batches(spark, 300, 300, 1, 600) == [0, 0, 1, 2]
    assert batches(spark, 700) == [0]
    assert batches(spark, 700, 1) == [0, 1]
    assert batches(spark) == []
    assert batches(spark, *[1] * 1300) == [0] * 600 + [1] * 600 + [2] * 100


def test_token_estimate(spark):
    assert [value(spark, T.estimate_tokens(F.lit("x" * n))) for n in (0, 1, 4, 5)] == [1, 1, 1, 2]
    assert value(spark, T.utf16_length(F.lit("a😀"))) == 3


def test_splits_are_lossless(spark):
    assert [len(x) for x in value(spark, T.hard_pieces(F.lit("x" * 5000), 2400))] == [2400, 2400, 200]
    text = "First pi is 3.14 ok. Second one!  Third?\n\nA new paragraph. " + "word " * 30 + "y" * 90
    parts = value(spark, segment.split_pieces(F.lit(text), 40))
    assert "".join(parts) == text and max(map(len, parts)) <= 40
    assert segment.packed(["aa", "b", "cccc", "d"], 4) == ["aab", "cccc", "d"] and segment.packed(["aaaaaa", "b"], 4) == ["aaaaaa", "b"]
    # paragraphs that fit stay whole; only the long one is cut further
    assert segment.cut_text("short.\n" + "one two. " * 3 + "\nend", 12) == ["short.\n", "one two. ", "one two. ", "one two. \n", "end"]


def test_recombine_orders_by_number(spark):
    rows = [Row(f=0, n=10, part=1, text="b"), Row(f=0, n=10, part=0, text="a"), Row(f=0, n=2, part=None, text="c")]
    out = segment.recombine(spark.createDataFrame(rows, "f int, n int, part int, text string"), ["f", "n"]).orderBy("f", "n")
    assert [(r.n, r.text) for r in out.collect()] == [(2, "c"), (10, "ab")]


def test_id_sets(spark):
    expected = spark.createDataFrame([(k, i) for k in (1, 2, 3, 4) for i in "ab"], "k int, item_id string")
    got = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "a", "x"), (2, "c", "x"), (3, "a", "x"), (3, "b", " "), (4, "a", "x"), (4, "b", "y")], "k int, item_id string, text string")
    assert {r.k: r.is_valid for r in memory.id_set_report(expected, got, "k").collect()} == {1: False, 2: False, 3: False, 4: True}


def paras(spark, *pages):
    rows = [(1, p, n, t) for p, page in enumerate(pages, 1) for n, t in enumerate(page)]
    return spark.createDataFrame(rows, "doc_id long, page int, para_no int, text string")


def left(df):
    return [r.text for r in df.orderBy("page", "para_no").collect()]


def test_headers_and_footers(spark):
    assert left(layout.strip_headers(paras(spark, ["H", "x"], ["H", "y"]))) == ["x", "y"]
    assert left(layout.strip_headers(paras(spark, ["H", "x"]))) == ["H", "x"]
    assert left(layout.strip_headers(paras(spark, ["H", "H", "x"], ["H", "y"]))) == ["x", "y"]
    assert left(layout.strip_headers(paras(spark, ["H", "x", "H"], ["H", "y", "H"]))) == ["x", "H", "y", "H"]
    assert left(layout.strip_headers(paras(spark, ["a", "H", "x"], ["b", "H", "y"]))) == ["a", "H", "x", "b", "H", "y"]
    assert left(layout.strip_footers(paras(spark, ["x", "1"], ["y", "2"]))) == ["x", "y"]
    assert left(layout.strip_footers(paras(spark, ["x", "1"], ["y", "z"]))) == ["x", "y", "z"]
    assert left(layout.strip_footers(paras(spark, ["x", "9", "End", "1"], ["y", "End", "2"]))) == ["x", "y"]
    assert left(layout.strip_footers(paras(spark, ["x", "1"]))) == ["x", "1"]


def sections(spark, *lines, pages=None):
    df = spark.createDataFrame([(1, p, i, t) for i, (p, t) in enumerate(zip(pages or [1] * len(lines), lines, strict=True))], "doc_id long, page int, pos int, text string")
    return [(r.title, r.n_paras) for r in layout.split_sections(df).orderBy("section_no").collect()]


def test_sections(spark):
    assert sections(spark, "intro", "Chapter 1", "body", "LOUD LINE", "more") == [("Preliminares", 1), ("Chapter 1", 1), ("LOUD LINE", 1)]
    assert sections(spark, "LOUD LINE", "body", "last", pages=[1, 1, 2]) == [("Página 1", 2), ("Página 2", 1)]
    assert sections(spark, "IV.", "THE SEA", "body") == [("IV. THE SEA", 1)]
    assert sections(spark, "4)", "THE SEA", "AND MORE", "body", "4)", "no title") == [("4) THE SEA AND MORE", 3)]
    assert sections(spark, "Chapter 1", "IV.", "THE SEA", pages=[1, 1, 2]) == [("Página 1", 2), ("Página 2", 1)]  # no body at all
    assert sections(spark, "Introducción", "a", "Introducción del libro", "PRÓLOGO", "b", "Capítulo uno: fin.") == [("Introducción", 2), ("PRÓLOGO", 2)]
    assert sections(spark, "iv. THE SEA", "b", "IV. THE SEA", "c") == [("iv. THE SEA", 1), ("IV. THE SEA", 1)]
    assert sections(spark, "IV.", "XVIII)", "A TITLE", "B TITLE", "C TITLE", "b") == [("C TITLE", 1)]  # three lines belong to IV.


def test_lines_join_by_their_first_item(spark):
    rows = [(1, 1, i, f"t{i}", float(i), y, 10.0) for i, y in enumerate((100.0, 98.0, 96.0))]
    items = spark.createDataFrame(rows, "doc_id long, page int, item_no int, str string, x double, y double, height double")
    assert [r.text for r in layout.assemble_lines(items).orderBy("line_no").collect()] == ["t0 t1", "t2"]
    assert document_sections(items).count() == 1


def test_heading_parents(spark):
    df = spark.createDataFrame([(1, i, lv) for i, lv in enumerate((1, 2, 3, 2, 1, 3), 1)], "doc_id long, pos int, level int")
    assert [r.parent_pos for r in layout.heading_parents(df).orderBy("pos").collect()] == [None, 1, 2, 1, None, 5]


def test_toc_links_need_one_target(spark):
    entries = spark.createDataFrame([(1, 1, "Intro .... 5"), (2, 1, "Intro .... 5")], "doc_id long, entry_no int, text string")
    targets = spark.createDataFrame([(1, "Intro", "a"), (2, "Intro", "a"), (2, "INTRO", "b")], "doc_id long, title string, anchor string")
    assert {r.doc_id: r.target for r in links.toc_links(entries, targets).collect()} == {1: "a", 2: None}


def test_isbn_and_dates(spark):
    assert value(spark, T.normalized_isbn(F.lit("978-0-00-000000-2"))) == "9780000000002"
    assert value(spark, T.normalized_isbn(F.lit("123"))) is None
    assert [value(spark, T.is_reading_date(F.lit(d))) for d in ("2026-02-28", "2026-02-30", "2026-2-1", "2026-02-28T10:00Z", "2026-02-28T10:00:00", "2026-02-28T10:00:00.123Z", "2026-02-28T25:00:00Z", "2026-02-28T10:00:00+02:00")] == [True, False, False, False, False, True, False, True]


def test_catalogue_merge_follows_order(spark):
    def merged(*rows):
        return catalog.merge_candidates(spark.createDataFrame([(1, i, None, *r) for i, r in enumerate(rows)], catalog.CANDIDATE)).orderBy("pos").collect()

    out = merged(("A", ["x"], "1234567890", None, None, []), ("S", ["y"], None, None, 1990, ["c"]), ("S", ["y"], "1234567890", "u", 1991, ["d"]))
    assert [(r.title, r.n_sources, r.first_publish_year) for r in out] == [("A", 2, 1991), ("S", 1, 1990)]
    # an ISBN that a merged record doesn't take on leads nowhere
    out = merged(("S", ["y"], "1111111111", None, None, []), ("S", ["y"], "2222222222", None, None, []), ("T", ["y"], "2222222222", None, None, []))
    assert [(r.title, r.isbn, r.n_sources) for r in out] == [("S", "1111111111", 2), ("T", "2222222222", 1)]
    out = merged(("Sin título", [], "1111111111", None, None, []), ("Ficción", ["z"], "1111111111", None, None, []), ("FICCION", ["Z"], None, "c", None, []))
    assert [(r.title, r.cover_url, r.n_sources) for r in out] == [("Ficción", "c", 3)]


def test_catalogue_merge_equals_a_plain_walk(spark):
    """Every query's candidates against a walk that looks through all merged records, with missing fields, ties of keys and many queries in a task."""
    r = random.Random(5)
    rows = [(q, i, r.choice([None, f"k{i}"]), r.choice(["A", "a", "Á", "B", "B b", "日本", None]), r.choice([None, [], ["X"], ["x"], ["Y"]]), r.choice([None, "1111111111", "2222222222", "3333333333"]), None, r.choice([None, 1990]), r.choice([None, ["c"], ["c", "d"]])) for q in range(150) for i in range(r.randrange(1, 9))]
    got = catalog.merge_candidates(spark.createDataFrame(rows, catalog.CANDIDATE)).orderBy("query_id", "pos").collect()
    fold = lambda t, a: re.sub("[^a-z0-9]+", " ", t.lower().replace("á", "a").replace("í", "i")).strip() + "|" + (a[0].lower() if a else "")
    want = []
    for q in range(150):
        merged, led = [], []
        for _, _, key, title, authors, isbn, _, year, cats in (x for x in rows if x[0] == q):
            title = title or catalog.PLACEHOLDER
            at = next((a for a, k, _ in reversed(led) if isbn and k == isbn), None)
            if at is None:
                at = next((a for a, _, s in reversed(led) if s != "|" and s == fold(title, authors)), None)
            if at is None:
                at = len(merged)
                merged.append([title, authors or [], isbn, key, year, cats or [], 1])
            else:
                m = merged[at]
                merged[at] = [title if m[0] == catalog.PLACEHOLDER else m[0], m[1] or authors or [], m[2] or isbn, m[3] or key, m[4] or year, m[5] + [c for c in cats or [] if c not in m[5]], m[6] + 1]
            led.append((at, merged[at][2], fold(*merged[at][:2])))
        want += [(q, i, *m) for i, m in enumerate(merged)]
    assert [(x.query_id, x.pos, x.title, x.authors, x.isbn, x.open_library_key, x.first_publish_year, x.categories, x.n_sources) for x in got] == want
    assert catalog.merge_candidates(spark.createDataFrame([], catalog.CANDIDATE)).count() == 0


def test_glossary(spark):
    rows = [(1, 0, "Bob", "B", None), (1, 1, "bob", "C", None), (1, 2, "Eve", " ", None)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, source string, target string, type string")
    assert [(r.source, r.target, r.type) for r in catalog.glossary(df).collect()] == [("Bob", "B", "term")]
    assert catalog.glossary(spark.createDataFrame([(1, 0, "a", "b", "verb"), (1, 1, "c", "d", "place")], df.schema)).select("type").collect() == [("term",), ("place",)]
    assert not catalog.user_glossary_is_valid(df).first().is_valid


def test_budget():
    use = lambda kind, id, n, i=0, o=0: {"kind": kind, "id": id, "requests": n, "input_bound": i, "output_tokens": o}
    caps = {s: dict.fromkeys(budget.COUNTERS, 10) for s in ("deployment", "job", "samples", "sample")}
    fold = lambda *rows, **more: list(budget.fold_admission(iter(rows), {**caps, **more}))
    assert fold(use("job", "a", 6), use("job", "a", 5), use("job", "a", 4)) == [None, "deployment", None]
    big = {"deployment": dict.fromkeys(budget.COUNTERS, 100)}
    assert fold(use("job", "a", 6), use("job", "a", 5), use("job", "b", 5), use("job", "a", 1, 11), use("job", "a", 1, 0, 11), **big) == [None, "job", None, "job", "job"]
    assert fold(use("sample", "a", 6), use("sample", "b", 5), use("sample", "b", 4), use("job", "a", 10), **big) == [None, "sample", None, None]


def test_ledgers_merge(spark):
    a, b = (spark.createDataFrame(x, "k string, n long") for x in ([("a", 3)], [("a", 5), ("b", 1)]))
    assert {r.k: r.n for r in budget.merge_ledgers(a, b, "k", ("n",)).collect()} == {"a": 5, "b": 1}


def test_status_change_respects_the_patch(spark):
    b = spark.createDataFrame([(1, "reading", None, None), (2, "reading", None, None)], "id int, status string, started_at string, finished_at string")
    p = spark.createDataFrame([(1, "read", None, False), (2, "read", None, True)], "id int, status string, finished_at string, has_finished boolean")
    assert {r.id: r.finished_at for r in readinglog.change_status(b, p, "now").collect()} == {1: "now", 2: None}


def test_activity_fills_months(spark):
    b = spark.createDataFrame([("read", "2026-03-01"), ("read", "2026-03-09"), ("abandoned", "2026-03-02")], "status string, finished_at string")
    assert [r.n_books for r in readinglog.monthly_activity(spark, b, "2026").orderBy("month").collect()] == [0, 0, 2, *[0] * 9]


def reasons(spark, *changes):
    base = {"expected": 1, "page": 1, "html": "<p>" + "x" * 200 + "</p>", "continues_previous": False, "join_previous_word": False, "is_toc": False, "is_blank": False, "figures": [], "source_text": "y" * 300}
    schema = f"n int, expected int, page int, html string, continues_previous boolean, join_previous_word boolean, is_toc boolean, is_blank boolean, figures {layout.FIGURES}, source_text string"
    rows = [(n, *{**base, **c}.values()) for n, c in enumerate(changes)]
    return [r.reason for r in layout.page_reason(spark.createDataFrame(rows, schema)).orderBy("n").collect()]


def test_page_checks(spark):
    text = lambda n: {"html": f"<p>{'x' * n}</p>"}
    assert reasons(spark, text(194), text(195)) == ["coverage", None]
    assert reasons(spark, {"html": f"<p>{'x ' * 195}</p>"}, {"html": "x " * 194}, {"html": f"<script>{'x' * 300}</script>{'x' * 100}"}) == [None, "coverage", "coverage"]  # white space and scripts don't count
    assert reasons(spark, {**text(9), "source_text": "y \ufffd" * 200}, {**text(9), "source_text": "-" * 200 + "y" * 200}) == [None, None]  # no source to measure by
    assert reasons(spark, {"page": 2}, {"is_toc": None}, {"join_previous_word": True}, {"join_previous_word": True, "continues_previous": True}) == ["structure", "structure", "structure", None]
    f = ("fig-1", "", 0.0, 0.5, 1.0, 0.5)
    img = "<img data-figure='fig-1'/>"
    assert reasons(spark, {"figures": [f]}, {"figures": [f], "html": "x" * 200 + img}, {"html": "x" * 200 + img}, {"figures": [f], "html": img * 2}) == ["references", None, "references", "references"]
    assert reasons(spark, {"figures": [(*f[:4], 1.1, 0.5)]}, {"figures": [(*f[:5], float("nan"))]}, {"figures": [f, f]}, {"figures": [("x", *f[1:])]}, {"figures": [f] * 17}) == ["figure"] * 4 + ["figures"]
    blank = {"html": "", "source_text": ""}
    assert reasons(spark, blank, {**blank, "is_blank": True}, {"is_blank": True}, {**blank, "html": img, "figures": [f]}) == ["blank", None, "blank", None]
    assert reasons(spark, {"html": "x" * 200 + "\ufffd" * 3}, {"html": "x" * 200 + "\ufffd" * 2}, {"html": "x" * 2000 + "\ufffd" * 9}) == ["damaged", None, None]


def test_job_list_and_records(spark):
    kinds = [("pdf-conversion", "done"), ("pdf-conversion", "paused"), ("epub-translation", "paused"), ("epub-translation", "pending"), ("pdf-conversion", "processing"), ("epub-translation", "pausing"), ("epub-translation", "processing"), ("pdf-conversion", "pausing"), ("pdf-conversion", "error")]
    rows = [(i, k, s, {2: 7, 3: 5}.get(i), f"2026-01-0{i + 1}") for i, (k, s) in enumerate(kinds)]
    df = spark.createDataFrame(rows, "job_id int, kind string, status string, queue_order long, created_at string")
    assert [r.job_id for r in jobs.list_order(df).orderBy("position").collect()] == [6, 5, 3, 2, 4, 7, 1, 8, 0]
    up = {r.job_id: r for r in jobs.upgrade_records(df.withColumn("started_at", F.lit("x")).withColumn("created_at", F.to_timestamp("created_at"))).collect()}
    assert {r.started_at for r in up.values()} == {None} and up[0].queue_order is None and up[3].queue_order == 5
    assert up[6].status == up[7].status == "paused" and up[6].queue_order == 1767744000000


def test_moving_touches_its_own_kind(spark):
    q = spark.createDataFrame([(i, "pdf", i) for i in range(4)] + [(10 + i, "translation", i) for i in range(3)], "job_id long, kind string, queue_order long")
    moves = spark.createDataFrame([(3, 0), (10, 99)], "job_id long, position int")
    got = {(r.kind, r.queue_order): r.job_id for r in jobs.move_in_queue(q, moves).collect()}
    assert [got["pdf", i] for i in range(4)] == [3, 0, 1, 2] and [got["translation", i] for i in range(3)] == [11, 12, 10]


def test_numbers_of_contents_lines(spark):
    strip = lambda t: value(spark, T.without_page_number(F.lit(t)))
    assert [strip(t) for t in ("Chapter2", "Intro .... iv", "Intro 12 ", "Intro..XIV", "A.5", "vivid")] == ["Chapter2", "Intro", "Intro", "Intro", "A.5", "vivid"]


def test_names_and_answers(spark):
    title = lambda n: tuple(value(spark, T.file_title(F.lit(n))))
    assert title("The_Sea -- A Writer -- 1999_B00ABCDEFG1.epub") == ("The Sea", ["A Writer"]) and title("a - b.pdf") == ("a - b", [])
    assert value(spark, T.imported_title(F.lit("el-mar-azul"))) == "El mar azul" and value(spark, T.imported_title(F.lit("A_b -- c"))) == "A b"
    assert value(spark, T.output_file_name(F.lit("/x/Mi libro (1).epub"))) == "translated-Mi-libro--1-.epub"
    long = value(spark, T.output_file_name(F.lit("x" * 300 + ".epub")))
    assert len(long) == 200 and long.endswith(".epub")
    clean = lambda t: value(spark, T.clean_translation(F.lit(t)))
    assert [clean(t) for t in ("[ES] Hola  tú", "translation: Hola", "Traducción : TRANSLATION: Hola", " a \t\n\n\n  b ", "[es]x")] == ["Hola tú", "Hola", "Hola", "a\n\n\nb", "x"]


def test_queue_and_replay(spark):
    q = spark.createDataFrame([(i, "pdf", i) for i in range(4)], "job_id long, kind string, queue_order long")
    moved = lambda job, to: [r.job_id for r in jobs.move_in_queue(q, spark.createDataFrame([(job, to)], "job_id long, position int")).orderBy("queue_order").collect()]
    assert moved(3, 0) == [3, 0, 1, 2] and moved(0, 2) == [1, 2, 0, 3] and moved(1, 99) == [0, 2, 3, 1]
    assert value(spark, jobs.replay(F.array(*map(F.lit, ("start", "resume", "pause", "stopped"))))) == "paused"


def test_free_names(spark):
    w = spark.createDataFrame([("f", "a", ".epub", i) for i in range(3)], "folder string, base string, ext string, pos int")
    t = spark.createDataFrame([("f", "a.epub"), ("f", "a (2).epub")], "folder string, name string")
    assert [r.name for r in archive.free_names(w, t).orderBy("pos").collect()] == ["a (1).epub", "a (3).epub", "a (4).epub"]


def test_translation_round_trip(spark, tmp_path):
    page = "<html><head><title>T</title><style>p{}</style></head><body><h1>The quiet lighthouse</h1><p>a &amp; b</p><pre>code</pre></body></html>"
    opf = '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator></metadata><manifest><item id="c" properties="cover-image" href="img%20/c.png"/></manifest></package>'
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", opf)
        z.writestr("OEBPS/c.xhtml", page)
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    entries = archives.zip_entries(archives.archive_files(spark, str(tmp_path)))
    assert entries.where("error is not null").count() == 1
    good = entries.where("error is null")
    meta = archives.epub_metadata(good).first()
    assert (meta.title, meta.authors, meta.cover_path) == ("Book", ["A", "B"], "OEBPS/img /c.png")
    pages = archives.markup_entries(good).select("archive", "file_idx", F.col("content").cast("string").alias("html"))
    nodes = archives.text_nodes(pages.select(F.struct("archive", "file_idx").alias("id"), "html"), "id", "html").select("id.*", "node_idx", "text")
    assert [r.text for r in nodes.orderBy("node_idx").collect()] == ["T", "The quiet lighthouse", "a & b"]
    none = spark.createDataFrame([], "source_text string, target_text string")
    done = translate_items(nodes, ["archive", "file_idx", "node_idx"], none)
    out = archives.build_archives(archives.rewrite_entries(good, done)).first()
    with zipfile.ZipFile(io.BytesIO(out.content)) as z:
        assert z.infolist()[0].filename == "mimetype"
        assert "[ES] The quiet lighthouse" in z.read("OEBPS/c.xhtml").decode() and "<pre>code</pre>" in z.read("OEBPS/c.xhtml").decode()


def test_texts_are_replaced_where_they_stand():
    source = '<p class="a b">p</p><p>x &amp; y</p>\n<p title="y"> y&nbsp;<br/>z<!-- y --></p><script>y</script>'
    nodes = archives.TextNodes(source).nodes
    assert [n[1] for n in nodes] == ["p", "x & y", "y", "z"]
    assert archives.with_texts(source, {0: "UNO", 1: "a < b & c", 2: "$1"}) == '<p class="a b">UNO</p><p>a &lt; b &amp; c</p>\n<p title="y"> $1&nbsp;<br/>z<!-- y --></p><script>y</script>'


def test_package_edits():
    opf = '<package><metadata xmlns:dc="d"><dc:title id="t">Old</dc:title><dc:creator id="a">A</dc:creator><dc:creator id="b">B</dc:creator><meta refines="#b" property="role">aut</meta><meta refines="#a" property="role">aut</meta><dc:date>1</dc:date></metadata><manifest/></package>'
    out = archives.edited_package(opf, {"title": [" New & old "], "creator": ["C"], "publisher": ["P"], "description": [""]})
    assert out == '<package><metadata xmlns:dc="d"><dc:title id="t">New &amp; old</dc:title><dc:creator id="a">C</dc:creator><meta refines="#a" property="role">aut</meta><dc:date>1</dc:date><dc:publisher>P</dc:publisher></metadata><manifest/></package>'


def test_hostile_archives(spark, tmp_path):
    def archive_of(name, *entries):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in entries:
                z.writestr(path, content)

    archive_of("zeros.zip", ("a.txt", b"\0" * (2 << 20)))
    archive_of("up.zip", ("../a.txt", b"1"))
    archive_of("good.zip", ("b.xhtml", b"1"), ("A.txt", b"2"), ("a.txt", b"3"))
    rows = archives.zip_entries(archives.archive_files(spark, str(tmp_path))).collect()
    assert sorted((r.path or r.error) for r in rows) == ["A.txt", "ValueError: compression ratio", "ValueError: unsafe or repeated names", "a.txt", "b.xhtml"]
    again = archives.build_archives(spark.createDataFrame([r for r in rows if r.path], archives.ENTRIES)).first()
    with zipfile.ZipFile(io.BytesIO(again.content)) as z:
        assert z.namelist() == ["b.xhtml", "A.txt", "a.txt"]


def test_folders(spark, tmp_path):
    (tmp_path / "x.sdr").mkdir()
    for name in ("Título -- Autora.epub", "b.pdf", "notes.txt", "x.sdr/c.epub"):
        (tmp_path / name).write_bytes(b"1")
    assert [(r.title, r.authors) for r in files.device_books(spark, str(tmp_path)).collect()] == [("b", []), ("Título", ["Autora"])]
    genuine = '{"id":"j-1","status":"processing","progress":{"current":1,"total":4,"message":"x"},"checkpointBatchIndex":1,"inputFileName":"a.epub","outputFileName":null,"inputFilePath":"/in/a","outputFilePath":"/out/a","error":null,"createdAt":"2026-01-02T03:04:05.000Z"}'
    bodies = (genuine, "{broken", genuine.replace('"id"', '"kind":"translation","id"'), genuine.replace('"error":null,', ""), genuine.replace('"id"', '"kind":null,"id"'))
    for i, body in enumerate(bodies):
        (tmp_path / "jobs" / str(i)).mkdir(parents=True)
        (tmp_path / "jobs" / str(i) / "job.json").write_text(body)
    sound, faults = files.job_records(spark, str(tmp_path / "jobs"))
    assert {(r.path[-10:-9], r.problem) for r in faults.collect()} == {("1", "unreadable"), ("2", "kind"), ("3", "files"), ("4", "kind")}
    up = jobs.upgrade_records(sound).first()
    assert (up.job_id, up.kind, up.status, up.progress.message, up.progress.total) == ("j-1", "epub-translation", "paused", "Pausada tras reiniciar el servidor", 4)
    assert (up.queue_order, up.started_at, up.archived, up.elapsed_ms, up.glossary, up.completed_chapters, up.translation_memory) == (1767323045000, None, False, 0, [], [], {})
    assert up.last_progress_at == up.created_at and up.completed_at is None


def test_a_stored_job_is_parsed_once(spark):
    """Whatever the rules name: not once for each field, nor again for the sample of a sort."""
    from lexweave.operators import records

    bodies = spark.createDataFrame([("{",), (None,), ("{}",)], "body string")
    judged = records.job_problem(bodies)
    assert [r.problem for r in judged.collect()] == ["unreadable", "unreadable", "id"]
    plan = judged.where("problem is null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("parseJson(") == 1
    assert "from_json(" not in files.job_rows(bodies)[0]._jdf.queryExecution().optimizedPlan().toString()


def test_a_hot_key_replays_in_many_parts(spark):
    r = random.Random(3)
    steps = ("start", "pause", "stopped", "resume", "finish", "fail", "unknown")
    rows = [(None if i % 50 == 0 else "hot" if r.random() < 0.9 else f"k{r.randrange(30)}", i, r.choice(steps)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, n int, e string")
    want, state = {}, {}
    for k, n, e in rows:
        state[k] = jobs.TRANSITIONS.get((state.get(k, "pending"), e), state.get(k, "pending"))
        want[n] = state[k]
    for parts in (None, 1, 23):
        out = jobs.replay_events(df, "k", ["n"], "e", parts=parts)
        assert {x.n: x.status for x in out.collect()} == want
    placed = parted(df, F.col("k"), F.col("n"), parts=23)
    assert placed.where("k = 'hot'").select("_part").distinct().count() > 15
    assert jobs.replay_events(df.where("false"), "k", ["n"], "e").count() == 0


def test_a_hot_deployment_is_admitted_in_many_parts(spark):
    r = random.Random(5)
    rows = []
    for i in range(3000):
        d = None if i % 40 == 0 else "hot" if r.random() < 0.85 else f"d{r.randrange(20)}"
        rows.append((d, i, r.choice(["job", "job", "sample"]), None if i % 31 == 0 else f"i{r.randrange(25)}", 1, r.randrange(300, 900), r.randrange(1, 60)))
    df = spark.createDataFrame(rows, "d string, n long, kind string, id string, requests long, input_bound long, output_tokens long")
    tight = {"deployment": {"requests": 900, "input_bound": 300_000, "output_tokens": 20_000}, "job": {"requests": 40, "input_bound": 30_000, "output_tokens": 900}, "samples": {"requests": 300, "input_bound": 90_000, "output_tokens": 5_000}, "sample": {"requests": 9, "input_bound": 4_000, "output_tokens": 200}}
    for caps in (tight, {k: {c: 10**9 for c in v} for k, v in tight.items()}, {k: {c: 700 for c in v} for k, v in tight.items()}):
        want, used = {}, {}
        for d, n, *rest in rows:
            one = dict(zip(("kind", "id", *budget.COUNTERS), rest, strict=True))
            want[n] = next(budget.fold_admission(iter([one]), caps, used.setdefault(d, {})))
        for parts in (1, 17):
            turns = []
            out = budget.admit(df, "d", ["n"], caps, parts=parts, report=turns).collect()
            assert {x.n: x.refused_by for x in out} == want and len(out) == len(rows)
            assert turns[0] == 0 if parts == 1 else turns[0] >= 1
    assert budget.admit(df.where("false"), "d", ["n"], tight).count() == 0


def test_an_outline_of_any_depth(spark):
    from lexweave.operators.outline import flatten_outline

    chain = [(1, i, i - 1 if i else None, 0, f"t{i}", 1 + i % 9) for i in range(2500)]
    broad = [(2, i, None, -i, "x", 1) for i in range(300)] + [(2, 1000 + i, 7, i, " " if i == 2 else "y", 1 if i else None) for i in range(4)]
    lost = [(3, 1, 2, 0, "a", 1), (3, 2, 1, 0, "b", 1), (3, 3, 9, 0, "c", 1), (3, 4, None, 0, "d", 1), (None, 5, None, 0, "e", 1), (4, 1, None, 0, "f", 11)]
    df = spark.createDataFrame(chain + broad + lost, "doc_id int, item_id int, parent_id int, pos int, title string, page int")
    out = flatten_outline(df, spark.createDataFrame([(i, 10) for i in range(1, 5)], "doc_id int, n_pages int")).collect()
    assert sorted((x.place, x.level, x.title) for x in out if x.doc_id == 1) == [(i, i + 1, f"t{i}") for i in range(2500)]
    two = {x.place: (x.level, x.title) for x in out if x.doc_id == 2}
    assert len(two) == 302 and two[292] == (1, "x") and 293 not in two and two[294] == (2, "y") and 295 not in two and two[296] == (2, "y") and two[303] == (1, "x")
    assert [(x.doc_id, x.title) for x in out if x.doc_id > 2] == [(3, "d")]


def test_leaves_of_an_outline_stay_out_of_the_rounds(spark, monkeypatch):
    """A root with 200 children, one of them with a child, beside lost items and an item alone: two items have children and are reached."""
    from lexweave.operators import outline

    seen, rounds = [], outline._doubled
    monkeypatch.setattr(outline, "_doubled", lambda links: seen.append(links.count()) or rounds(links))
    rows = [(1, 0, None, 0)] + [(1, i, 0, -i) for i in range(1, 201)] + [(1, 500, 7, 0), (1, 600, 999, 0), (2, 1, None, 0), (3, 1, 2, 0), (3, 2, 1, 0), (3, 3, 2, 0)]
    df = spark.createDataFrame(rows, "doc_id int, item_id int, parent_id int, pos int").selectExpr("*", "concat('t', item_id) as title", "1 as page")
    out = outline.flatten_outline(df, spark.createDataFrame([(i, 10) for i in range(1, 4)], "doc_id int, n_pages int")).collect()
    want = [(1, 0, "t0", 1)] + [(1, 201 - i + (i < 7), f"t{i}", 2) for i in range(1, 201)] + [(1, 195, "t500", 3), (2, 0, "t1", 1)]
    assert sorted((r.doc_id, r.place, r.title, r.level) for r in out) == sorted(want)
    assert seen == [4]  # and the two of a circle


def test_title_lines_are_consumed_exactly(spark):
    def walk(pages):
        """Numbered headings take up to three upper-case lines; the walk goes on behind them."""
        upper, number = lambda t: t.isupper() and sum(c.isalpha() for c in t) >= 4 and t[-1] not in ".!?;:", lambda t: t.rstrip(".)").isalnum() and t[-1] in ".)" and set(t[:-1].lower()) <= set("ivxlcdm")
        flat, i, out, now, found = [t for p in pages for t in p], 0, [], ("Preliminares", 0), False
        while i < len(flat):
            head, used = None, 0
            if number(flat[i]):
                lines = []
                for t in flat[i + 1 : i + 4]:
                    if not upper(t):
                        break
                    lines.append(t)
                if lines:
                    head, used = " ".join([flat[i], *lines]), len(lines)
            elif flat[i].startswith("Chapter ") or found and upper(flat[i]):
                head = flat[i]
            if head:
                found = True
                out, now = out + [now] * (now[1] > 0), (head, 0)
            else:
                now = (now[0], now[1] + 1)
            i += 1 + used
        out += [now] * (now[1] > 0)
        return out if found and out else [(f"Página {k}", max(len(p), 1)) for k, p in enumerate(pages, 1)]

    r = random.Random(11)
    docs = [[["XVIII)"] * 5 + ["body"]], [["IV.", "XVIII)", "XVIII)", "XVIII)", "XVIII)", "XVIII)", "body", "THE SEA", "end"]], [[], ["a"], []], [["THE SEA"], []], [["a"] * 3, ["XVIII)"]]]
    docs += [[[r.choice(["XVIII)", "XVIII)", "IV.", "THE SEA", "text", "Chapter 1"]) for _ in range(r.randrange(8))] for _ in range(3)] for _ in range(60)]
    paras = [(d, p, 100 * p + i, t) for d, pages in enumerate(docs) for p, ts in enumerate(pages, 1) for i, t in enumerate(ts)]
    pages = spark.createDataFrame([(d, p) for d, ps in enumerate(docs) for p in range(1, len(ps) + 1)], "doc_id long, page int")
    for parts in (1, 9):
        got = layout.split_sections(spark.createDataFrame(paras, "doc_id long, page int, pos int, text string"), pages, parts=parts).orderBy("doc_id", "section_no").collect()
        for d, ps in enumerate(docs):
            assert [(x.title, x.n_paras) for x in got if x.doc_id == d] == walk(ps), ps
            assert [x.section_no for x in got if x.doc_id == d] == list(range(len(walk(ps))))


def test_lines_stand_around_their_first_item(spark):
    items = [(1, 1, i, t, x, y, h) for i, (t, x, y, h) in enumerate([("a-", 5.0, 100.0, 8.0), ("b", 9.0, 99.0, -12.0), ("c", 1.0, 96.0, 8.0), ("d", 2.0, 94.0, 0.2), (" ", 1.0, 50.0, 8.0), ("e", 1.0, 70.0, None), (None, 1.0, 60.0, 8.0), ("f", None, None, 8.0)])]
    df = spark.createDataFrame(items, "doc_id long, page int, item_no int, str string, x double, y double, height double")
    assert [(r.line_no, r.text, r.y, r.height) for r in layout.assemble_lines(df).orderBy("line_no").collect()] == [(0, "a-b", 100.0, 12.0), (1, "c d", 96.0, 8.0), (2, "e", 70.0, 10.0), (3, "f", 0.0, 8.0)]
    assert [r.text for r in layout.assemble_paragraphs(layout.assemble_lines(df)).orderBy("para_no").collect()] == ["a-b c d", "e", "f"]


def test_answered_texts_are_not_asked_for_again(spark, tmp_path):
    from lexweave.plans.translate import BudgetExceeded, _attempts, answers, translate_durably

    texts = spark.createDataFrame([(f"t{i}",) for i in range(40)] + [("t1",), (None,)], "text string")
    asked = tmp_path / "asked"
    asked.mkdir()

    def note(batch, how, log=str(asked)):
        import uuid

        with open(f"{log}/{how}-{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(batch))

    def dying(batch):
        if "t7" in batch or "t20" in batch:
            import os

            os._exit(1)  # the worker is gone, and with it this request only
        note(batch, "a")
        return [t.upper() for t in batch]

    def broke(batch):
        if "t20" in batch:
            raise BudgetExceeded
        note(batch, "b")
        return [t.upper() for t in batch]

    def picky(batch):
        note(batch, "c")
        if len(batch) > 1:
            raise ConnectionError
        return [t.upper() for t in batch]

    at = str(tmp_path / "ledger")
    for translator, error in ((dying, Exception), (broke, BudgetExceeded)):
        try:
            translate_durably(texts, translator, at, batch=4)
            raise AssertionError
        except error:
            pass
    early = {r.source_text for r in answers(spark, at).collect()}
    assert early and "t20" not in early and "t7" in early
    out = translate_durably(texts, picky, at, batch=4, tries=2)
    assert {(r.source_text, r.target_text) for r in out.collect()} == {(f"t{i}", f"T{i}") for i in range(40)}
    said = {how: [t for f in asked.glob(f"{how}-*") for t in f.read_text().split("\n")] for how in "abc"}
    assert len(said["b"]) == len(set(said["b"])) and not early & set(said["c"])
    assert not {r.source_text for r in _attempts(spark, at).where("answers is not null").selectExpr("explode(texts) as source_text").groupBy("source_text").count().where("count > 1").collect()}

    def deaf(batch):
        raise ConnectionError

    try:
        translate_durably(spark.createDataFrame([("new",), ("t1",)], "text string"), deaf, at, tries=2)
        raise AssertionError
    except RuntimeError as e:
        assert "1 texts" in str(e)


def test_rounds_leave_failed_texts_where_they_lie(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from lexweave.plans import translate

    written = []
    monkeypatch.setattr(translate, "materialize", lambda df, write=translate.materialize: written.append(1) or write(df))
    monkeypatch.setattr(DataFrame, "repartition", None)
    texts = spark.range(500).selectExpr("concat('t', id % 450) as text")

    def picky(batch):
        if len(batch) > 1 and "t7" in batch:
            raise ConnectionError
        return [t.upper() for t in batch]

    out = translate.translate_durably(texts, picky, str(tmp_path / "ledger"), batch=200, tries=2, most_tasks=1)
    assert sorted(tuple(r) for r in out.collect()) == sorted((f"t{i}", f"T{i}") for i in range(450))
    assert len(written) == 1  # not once more in each of the rounds
    sizes = sorted(len(r.texts) for r in translate._attempts(spark, str(tmp_path / "ledger")).where("not contains(batch, '.')").dropDuplicates(["batch"]).collect())
    assert sum(sizes) == 450 and max(sizes) == 200


def test_titles_of_outlines_join_in_bounded_parts(spark, monkeypatch):
    from lexweave.operators import outline

    monkeypatch.setattr(outline, "PART_ROWS", 10)
    items = spark.range(200).selectExpr("id % 2 as doc_id", "id as item_id", "if(id < 2, null, id - 2) as parent_id", "id as pos", "if(id % 7 = 3, ' ', concat(' t', id)) as title", "if(id % 5 = 2, null, cast(id as int)) as page")
    out = outline.flatten_outline(items, spark.createDataFrame([(0, 150), (1, 60)], "doc_id long, n_pages int"))
    assert out.rdd.getNumPartitions() >= 20
    want = {(i % 2, i // 2, f"t{i}", i, i // 2 + 1) for i in range(1, 200) if i % 7 != 3 and i % 5 != 2 and i <= (60 if i % 2 else 150)}
    assert {tuple(r) for r in out.collect()} == want


def test_a_broken_off_stream_ends_alike(spark, tmp_path):
    from lexweave.streaming.resume import read_written, write_once

    for i in range(4):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    calls = []

    def stumbling(df):
        calls.append(1)
        if len(calls) == 3:
            df.limit(3).write.mode("overwrite").parquet(str(tmp_path / "out" / "batch=2"))  # half a batch stands
            raise RuntimeError("killed")
        return df

    try:
        write_once(stream(), str(tmp_path / "out"), str(tmp_path / "state"), stumbling).awaitTermination()
        raise AssertionError
    except Exception as e:  # noqa: BLE001
        assert "killed" in str(e)
    write_once(stream(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    write_once(stream(), str(tmp_path / "once"), str(tmp_path / "state2")).awaitTermination()
    rows = lambda where: sorted((r.batch, r.id) for r in read_written(spark, str(tmp_path / where)).collect())
    assert rows("out") == rows("once") and len(rows("out")) == 40


def test_restoring_keeps_what_was_there(spark):
    from lexweave.operators import revisions

    rid = lambda n: f"170000000000{n}-" + "a" * 36
    js = spark.createDataFrame([(1, "done", "a.epub", "now1"), (2, "paused", "b.epub", "now2"), (3, "done", None, "now3"), (4, "done", "d.epub", "now4"), (5, "done", "e.epub", "now5")], "job_id int, status string, output_file string, content string")
    rs = spark.createDataFrame([(j, rid(n), n, "x", f"old{j}{n}") for j in (1, 2, 3, 4) for n in (1, 2)] + [(5, "../x", 1, "x", "bad")], "job_id int, revision_id string, created_at int, file_name string, content string")
    asked = spark.createDataFrame([(1, rid(1), 9, rid(9)), (2, rid(1), 9, rid(9)), (3, rid(1), 9, rid(9)), (4, rid(7), 9, rid(9)), (5, "../x", 9, rid(9))], "job_id int, revision_id string, at int, new_id string")
    after, added = revisions.restore(js, rs, asked)
    assert {(r.job_id, r.content, r.outcome) for r in after.collect()} == {(1, "old11", "restored"), (2, "now2", "refused"), (3, "now3", "refused"), (4, "now4", "refused"), (5, "now5", "refused")}
    assert [tuple(r) for r in added.collect()] == [(1, rid(9), 9, "a.epub", "now1")]
    more = rs.unionByName(added)
    back = revisions.as_of(more, spark.createDataFrame([(1, 1), (1, 8), (1, 9), (1, 0)], "job_id int, at int"))
    assert {(r.at, r.content) for r in back.collect()} == {(1, "old11"), (8, "old12"), (9, "now1"), (0, None)}


def test_upserts_leave_other_files_alone(spark, tmp_path):
    from lexweave.sources.store import read_store, upsert

    schema, at = "id long, version int, value string, is_deleted boolean", str(tmp_path / "store")
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    assert upsert(rows(), at) == 0
    upsert(rows(*[(i, 1, f"a{i}", False) for i in range(200)], (None, 1, "n", False)), at, buckets=8)
    files = lambda: {str(p.relative_to(at)) for p in (tmp_path / "store").rglob("*.parquet")}
    before = files()
    change = rows((3, 2, "b3", False), (4, 2, None, True), (900, 1, "new", False))
    assert upsert(change, at, buckets=8) <= 3
    after = files()
    assert len(before & after) >= 5 and before - after
    state = lambda: {r.id: r.value for r in read_store(spark, at, "id long, version int, value string, is_deleted boolean, _bucket int").collect()}
    want = {**{i: f"a{i}" for i in range(200) if i != 4}, 3: "b3", 900: "new", None: "n"}
    assert state() == want
    upsert(change, at, buckets=8)  # a replay
    upsert(rows((4, 1, "late", False), (3, 1, "old", False)), at, buckets=8)
    assert state() == want
    upsert(rows(*[(i, 9, None, True) for i in range(200)]), at, buckets=8)
    assert state() == {900: "new", None: "n"}


def test_an_index_finds_what_a_scan_finds(spark):
    books = spark.createDataFrame([(i, t, f"f{i}.epub", "Núñez" if i % 2 else None) for i, t in enumerate(["El camión", "CAMION azul", "ab", "a", None, "miónca", "camín"])], "id int, title string, file_name string, authors string")
    postings = readinglog.search_postings(books, "id")
    find = lambda q: {r.id for r in readinglog.indexed_search(books, "id", postings, q).collect()}
    assert find(" Camio ") == {0, 1} and find("nunez") == {1, 3, 5} and find("a") == {0, 1, 2, 3, 5, 6} and find("camionx") == set() and find("f4.e") == {4} and find("") == set(range(7))


def test_missing_assets_without_a_join(spark):
    rows = lambda *r: spark.createDataFrame(r, "doc_id int, path string")
    gone = links.missing_assets(rows((1, "a"), (1, "a"), (1, "b"), (1, "b"), (2, "b"), (None, "a"), (1, None)), rows((1, "b"), (1, "b"), (2, "a"), (None, "a"), (1, None), (3, "c")))
    assert sorted(map(tuple, gone.collect()), key=str) == [(1, "a"), (1, None), (2, "b"), (None, "a")]
    assert "Join" not in gone._jdf.queryExecution().optimizedPlan().toString()


def test_an_index_is_made_without_a_shuffle(spark):
    """In order of its runs within a batch, each once for a book; characters beyond 16 bits and marks count as they stand."""
    texts = [f"abcabc {i % 7} Éa\u0302\u0301b \U0001f600\U0001f600\U0001f600\U0001f600" for i in range(50)] + ["xy", "", None]
    books = spark.createDataFrame(list(enumerate(texts)), "id int, title string").selectExpr("id", "title", "'' as file_name", "'' as authors").coalesce(1)
    postings = readinglog.search_postings(books, "id")
    got = [(r.gram, r.id) for r in postings.collect()]
    plain = lambda t: f"{t}  ".lower().replace("é", "e").replace("\u0302\u0301", "") if t is not None else "  "
    text = {r.id: r.t for r in books.select("id", readinglog.search_text().alias("t")).collect()}
    assert all(text[i].strip() == plain(t).strip() for i, t in enumerate(texts))
    assert sorted(got) == sorted({(t[k : k + 3], i) for i, t in text.items() for k in range(len(t) - 2)}) and [g for g, _ in got] == sorted(g for g, _ in got)
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    assert T.without_accents("Ça\u0323\u0307 \u1e69가") == "Ca s가".replace("가", "\u1100\u1161")


def test_free_names_beside_many_taken_ones(spark):
    """Against a walk over the numbers: taken ones with gaps, and such as have more than five digits."""
    taken = {0, 1, 4, 5, 9, 123456}
    names = [("f", "a.epub" if n == 0 else f"a ({n}).epub") for n in taken] + [("g", "b (7654321).epub")]
    wishes = [("f", "a", ".epub", k) for k in range(40)] + [("g", "b", ".epub", k) for k in range(3)]
    got = archive.free_names(spark.createDataFrame(wishes, "folder string, base string, ext string, pos long"), spark.createDataFrame(names, "folder string, name string"))
    free = [n for n in range(100) if n not in taken][:40]
    want = [f"a ({n}).epub" for n in free] + ["b.epub", "b (1).epub", "b (2).epub"]
    assert [r.name for r in got.orderBy("folder", "pos").collect()] == want


def test_a_line_of_many_items(spark):
    """A page with one long line: time grows with its items, not with their square, and all stand in it."""
    n = 240_000
    items = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(2).alias("page"), F.col("id").alias("item_no"), F.when(F.col("id") % 3 == 0, "ab-").otherwise("cd").alias("str"), F.lit(1.0).alias("x"), F.lit(7.0).alias("y"), F.lit(8.0).alias("height"))
    began = time.perf_counter()
    lines = layout.assemble_lines(items)
    paras = layout.assemble_paragraphs(lines.unionByName(lines.withColumn("line_no", F.lit(1)))).collect()
    text = "".join("ab-" if i % 3 == 0 else "cd " for i in range(n)).rstrip(" ")
    assert [r.text for r in paras] == [f"{text} {text}"]
    assert time.perf_counter() - began < 15


def test_python_gets_small_batches_of_long_texts(spark):
    """At most 2 MB of texts at once where a table is written so; the session's own setting is as before."""
    held = F.pandas_udf(lambda x: pd.Series([int(x.str.len().sum())] * len(x)), "long")
    before = spark.conf.get(BATCH)
    rows = materialize(spark.range(0, 400, 1, 1).select(held(F.repeat(F.lit("x"), (F.col("id") * 0 + 100_000).cast("int"))).alias("n")), "2m")
    assert rows.count() == 400 and rows.agg(F.max("n")).first()[0] <= 2_200_000 and spark.conf.get(BATCH) == before
