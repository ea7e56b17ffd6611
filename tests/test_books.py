"""Books from pages, replies of models, and retries, on literal rows."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lexweave.functions import markup, replies
from lexweave.operators import book, layout, outline
from lexweave.plans.translate import BudgetExceeded, with_bisection
from lexweave.sources import archives


def pages_of(spark, *pages):
    rows = [(1, n, html, cont, word, toc, []) for n, (html, cont, word, toc) in enumerate(pages, 1)]
    return spark.createDataFrame(rows, f"doc_id long, page int, html string, continues_previous boolean, join_previous_word boolean, is_toc boolean, figures {layout.FIGURES}")


def none(spark):
    return spark.createDataFrame([], "doc_id long, title string, page int, level int")


def test_pages_join_and_chapters_split(spark):
    pages = pages_of(
        spark,
        ("<h1>One</h1><p>a wo-</p>", False, False, False),
        ("<p>rd goes on</p><p>b</p>", True, True, False),
        ("<p>and on</p>", True, False, False),
        ("<p>x</p>", True, False, False),  # the page before is empty now, so nothing ends there
        ('<h2>Sub</h2><h1>Two</h1><p><a href="#p1-heading-1">back</a> <a href="#nowhere">no</a></p>', False, False, False),
    )
    prepared = book.prepare_pages(pages)
    html = [r.html for r in prepared.orderBy("page").collect()]
    mark = lambda n: f'<span id="page-{n}" epub:type="pagebreak" title="{n}"/>'
    assert html[0] == f'{mark(1)}<h1 id="p1-heading-1">One</h1><p>a wo{mark(2)}rd goes on</p>'
    assert html[1] == f"<p>b{mark(3)} and on</p>" and html[2] == "" and html[3] == f"{mark(4)}<p>x</p>"
    books = spark.createDataFrame([(1, "Book & co", "A", None)], "doc_id long, title string, author string, language string")
    parts = book.chapters(prepared, none(spark), books)
    assert [(r.chapter_no, r.title, r.n_pages) for r in parts.orderBy("chapter_no").collect()] == [(1, "One", 4), (2, "Two", 1)]
    linked = {r.chapter_no: r.html for r in book.link_chapters(parts).collect()}
    assert '<a href="../sections/chapter-1.xhtml#p1-heading-1">back</a> <a>no</a>' in linked[2]
    toc = book.contents(prepared, none(spark), parts).first().toc
    assert toc == '<ol><li><a href="sections/chapter-1.xhtml#p1-heading-1">One</a><ol><li><a href="sections/chapter-2.xhtml#p5-heading-1">Sub</a></li></ol></li><li><a href="sections/chapter-2.xhtml#p5-heading-2">Two</a></li></ol>'
    built = archives.build_archives(book.structured_book(pages, none(spark), books)).first()
    with zipfile.ZipFile(io.BytesIO(built.content)) as z:
        assert z.namelist() == ["mimetype", "META-INF/container.xml", "OEBPS/book.css", "OEBPS/nav.xhtml", "OEBPS/content.opf", "OEBPS/sections/chapter-1.xhtml", "OEBPS/sections/chapter-2.xhtml"]
    entries = archives.zip_entries(spark.createDataFrame([("b", bytearray(built.content))], "path string, content binary"))
    meta = archives.epub_metadata(entries).first()
    assert (meta.title, meta.authors, meta.language) == ("Book & co", ["A"], "und")


def test_bookmarks_open_chapters_and_name_places(spark):
    pages = pages_of(spark, ("<p>front</p>", False, False, False), ("<h2>Inner</h2><p>x</p>", False, False, False), ("<p>y</p>", False, False, False))
    marks = spark.createDataFrame([(1, "Start", 2, 1), (1, "INNER", 2, 2), (1, "Later", 3, 2)], "doc_id long, title string, page int, level int")
    prepared = book.prepare_pages(pages)
    parts = book.chapters(prepared, marks, spark.createDataFrame([(1, "B")], "doc_id long, title string"))
    assert [(r.chapter_no, r.title) for r in parts.orderBy("chapter_no").collect()] == [(1, "B"), (2, "Start")]
    toc = book.contents(prepared, marks, parts).first().toc
    assert "#page-3" in toc and '#p2-heading-1">INNER' in toc


def test_simple_book(spark):
    rows = [(1, 0, "Uno", 0, "a < b"), (1, 0, "Uno", 1, "c"), (1, 1, None, 2, "d")]
    books = spark.createDataFrame([(1, "T", None, "es")], "doc_id long, title string, author string, language string")
    got = {r.path: r.content.decode() for r in book.simple_book(spark.createDataFrame(rows, "doc_id long, section_no int, title string, pos int, text string"), books).collect()}
    assert "<h1>Uno</h1><p>a &lt; b</p>\n<p>c</p>" in got["OEBPS/sections/chapter-1.xhtml"] and "<dc:creator>" not in got["OEBPS/content.opf"]
    assert got["OEBPS/nav.xhtml"].count("<li>") == 2 and "section-2" in got["OEBPS/nav.xhtml"]


@pytest.mark.parametrize(
    "reply, found",
    [
        ('{"a": 1}', '{"a": 1}'),
        ('text ```JSON\n[1, 2]\n``` more {"b": 2}', "[1, 2]"),
        ("so [this] is { not } but {\"x\": [\"}\", {\"y\": 1}]} is", '{"x": ["}", {"y": 1}]}'),
        ("[1, 2", None),
        ("NaN", None),
        ("nothing", None),
    ],
)
def test_json_in_replies(reply, found):
    assert replies.json_in(reply) == found


def test_safe_markup():
    dirty = '<p onclick="x" id="note">a<script>b</script><font>c</font> <a href=" JavaScript:x">d</a><a href="HTTP://e">e</a><img data-figure="fig-2"></p><p id="note">f'
    assert markup.safe_markup(3, dirty, {}) == '<p id="p3-note">ac <a>d</a><a href="HTTP://e">e</a></p><p>f</p>'
    assert markup.safe_markup(3, '<td colspan="2" rowspan="x"><a id="p3-x" href="#page-9" role="doc-noteref">1</a></td>', {}) == '<td colspan="2"><a id="p3-x" href="#page-9" epub:type="noteref" class="noteref">1</a></td>'
    assert markup.plain_text("<h1>A</h1><p>b<br>c</p>  d &amp; e") == "A b c d & e"


def test_bisecting_retry():
    asked = []

    def picky(texts):
        asked.append(len(texts))
        if len(texts) > 2 or "bad" in texts and len(texts) > 1:
            raise OSError("too much")
        return [] if asked.count(len(texts)) == 1 else [t.upper() for t in texts]

    assert with_bisection(picky)(["a", "b", "bad", "c", "d"]) == ["A", "B", "BAD", "C", "D"]
    assert asked[:3] == [5, 5, 5] and asked[3:6] == [3, 3, 3]
    with pytest.raises(RuntimeError):
        with_bisection(lambda texts: ["" for _ in texts])(["a", "b"])
    with pytest.raises(BudgetExceeded):
        with_bisection(lambda texts: (_ for _ in ()).throw(BudgetExceeded()))(["a", "b"])


def test_keyed_metadata(spark):
    block = b"xxkindle_title_metadata..author\x81Some_Writer\x00\x02title\x88\xe2El-mar-azul\x01ASIN B000kindle_ebook_metadata"
    df = spark.createDataFrame([("a.kfx", bytearray(block)), ("b.kfx", bytearray(b"none"))], "path string, content binary")
    assert {r.path: (r.title, r.authors) for r in outline.keyed_metadata(df).collect()} == {"a.kfx": ("El mar azul", ["Some Writer"]), "b.kfx": (None, [])}
    assert spark.range(1).select(replies.redacted(F.lit("key k1 k1"), F.lit("k1")).alias("x")).first().x == "key [redacted] [redacted]"


def test_markup_and_replies_of_any_depth(spark):
    from lexweave.functions import replies

    deep = "<div>" * 10_000 + "x<script>y</script>" + "</div>" * 10_000
    assert markup.plain_text(deep) == "xy" and len(list(markup.walk(markup.Fragment(deep).root))) == 10_003
    assert markup.safe_markup(1, deep, {}) == "<div>" * 10_000 + "x" + "</div>" * 10_000
    assert markup.safe_markup(1, "<p><img data-figure='f'><img data-figure='g'>a</p>", {"f": ""}) == '<p><img src="../images/p1-f.png" alt=""/>a</p>'
    assert replies.json_in("[" * 200_000) is None and replies.json_in("```json\n" + "[" * 200_000 + "\n```") is None
    assert replies.json_in("see [1] or {") == "[1]"
