"""Books from pages or sections: headings, contents, joined paragraphs, chapters, links, and the entries of the archive.

Relational steps over rows of pages; Python only reads or rewrites the markup of one page or chapter. Entries go to
``sources.archives.build_archives``.
"""

from __future__ import annotations

import re
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from lexweave.functions.markup import Element, Fragment, plain_text, sanitize_html, walk
from lexweave.functions.text import section_slug, trim_all, xml_escape
from lexweave.operators.layout import chapter_numbers
from lexweave.operators.links import book_targets
from lexweave.session import materialize, release

BODY = r"<(?:p|h[1-6]|figure|table|ul|ol)\b"
CONTAINER = '<?xml version="1.0" encoding="UTF-8"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
XHTML = 'xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"'


def written(e: Element, inside: bool = False) -> str:
    """An element (or what it holds) as XML."""
    text = "".join(escape(c, quote=False) if isinstance(c, str) else written(c) for c in e.children)
    if inside or not e.tag:
        return text
    head = e.tag + "".join(f' {k}="{escape(v)}"' for k, v in e.attributes.items())
    return f"<{head}>{text}</{e.tag}>" if text else f"<{head}/>"


HEADING = StructType([StructField("level", IntegerType()), StructField("title", StringType()), StructField("anchor", StringType())])
PREPARED = StructType([StructField("html", StringType()), StructField("headings", ArrayType(HEADING)), StructField("starts", BooleanType()), StructField("ends", BooleanType()), StructField("alone", BooleanType()), StructField("lead", StringType()), StructField("lead_id", StringType())])


@F.pandas_udf(PREPARED)
def _prepared(page: pd.Series, html: pd.Series) -> pd.DataFrame:
    """Headings with anchors of their own, and how the page begins and ends."""
    out = []
    for number, markup in zip(page, html, strict=True):
        root = Fragment(markup or "").root
        elements = [e for e in walk(root) if isinstance(e, Element)]
        taken = {e.attributes.get("id") for e in elements}
        found = []
        for k, e in enumerate(x for x in elements if re.fullmatch("h[1-6]", x.tag)):
            if not e.attributes.get("id"):
                name = f"p{number}-heading-{k + 1}"
                while name in taken:
                    name += "-h"
                taken.add(name)
                e.attributes["id"] = name
            found.append((int(e.tag[1]), plain_text(written(e)), e.attributes["id"]))
        top = [c for c in root.children if isinstance(c, Element)]
        first = top[0] if top and top[0].tag == "p" else None
        out.append((written(root), found, first is not None, bool(top) and top[-1].tag == "p", len(top) == 1, written(first, True) if first else None, first.attributes.get("id") if first else None))
    return pd.DataFrame(out, columns=[f.name for f in PREPARED])


@F.pandas_udf(StringType())
def _joined(html: pd.Series, moved: pd.Series, more: pd.Series, word: pd.Series) -> pd.Series:
    """A page without its first paragraph, if that moved, and with what the next page adds to its last one."""
    out = []
    for markup, gone, extra, cut in zip(html, moved, more, word, strict=True):
        root = Fragment(markup or "").root
        if gone:
            root.children.remove(next(c for c in root.children if isinstance(c, Element)))
        text = written(root)
        if extra is not None and text.rstrip().endswith(("</p>", "<p/>")):
            text = text.rstrip()
            body = text[: -len("</p>")] if text.endswith("</p>") else text[: -len("<p/>")] + "<p>"
            body = re.sub(r"-((?:</(?:em|strong|span|i|b)>)*\s*)\Z", r"\1", body) if cut else body
            text = body + extra + "</p>"
        out.append(text)
    return pd.Series(out)


def prepare_pages(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page, html, continues_previous, join_previous_word, is_toc, figures)`` with safe ``html`` and ``headings``; paragraphs
    that go on over a page's end are joined and page anchors stand where pages begin.

    A page joins the one before if it says so, is no contents page, and one ends and the other begins with a paragraph.
    """
    x = pages.withColumn("_p", _prepared("page", sanitize_html(F.col("page"), F.col("html"), F.col("figures")))).select("doc_id", "page", "continues_previous", "join_previous_word", "is_toc", "_p.*")
    w = Window.partitionBy("doc_id").orderBy("page")
    # a page of one paragraph that moved has none left for the next to join: such pages take turns
    base = F.coalesce(F.col("continues_previous") & ~F.col("is_toc") & F.col("starts") & F.lag("ends").over(w), F.lit(False))
    x = x.withColumns({"_base": base, "_bound": base & F.coalesce(F.lag("alone").over(w), F.lit(False))})
    x = x.withColumn("_run", F.sum((~F.col("_bound")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("doc_id", "_run").orderBy("page")
    x = x.withColumn("_moved", F.when((F.row_number().over(run) - 1) % 2 == 0, F.first("_base").over(run)).otherwise(~F.first("_base").over(run)))
    anchor = F.concat(F.lit('<span id="page-'), F.col("page").cast("string"), F.lit('" epub:type="pagebreak" title="'), F.col("page").cast("string"), F.lit('"/>'))
    old = F.coalesce(F.concat(F.lit('<span id="'), xml_escape(F.col("lead_id")), F.lit('"/>')), F.lit(""))
    gift = F.when(F.col("_moved"), F.struct(F.concat(anchor, old, F.when(F.col("join_previous_word"), "").otherwise(" "), "lead").alias("t"), "join_previous_word"))
    x = x.withColumns({"_anchor": F.when(~F.col("_moved"), anchor).otherwise(""), "_next": F.lead(gift).over(w)})
    html = F.concat("_anchor", _joined("html", "_moved", F.col("_next")["t"], F.coalesce(F.col("_next")["join_previous_word"], F.lit(False))))
    return x.select("doc_id", "page", "is_toc", html.alias("html"), F.when(F.col("is_toc"), F.array().cast(ArrayType(HEADING))).otherwise(F.col("headings")).alias("headings"))


def heading_rows(prepared: DataFrame) -> DataFrame:
    return prepared.select("doc_id", "page", F.posexplode("headings").alias("pos", "h")).select("doc_id", "page", "pos", "h.level", "h.title", "h.anchor")


def chapters(prepared: DataFrame, bookmarks: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, chapter_no, title, html, n_pages), chapters from 1: a page with a first-level bookmark, or with a heading of the document's
    least level, opens one if the chapter before has a body, else names it anew. ``titles(doc_id, title)`` are the books'."""
    h = heading_rows(prepared)
    least = h.groupBy("doc_id").agg(F.least(F.min("level"), F.lit(6)).alias("_least"))
    named = h.join(least, "doc_id").where("level = _least").groupBy("doc_id", "page").agg(F.min_by("title", "pos").alias("_h"))
    marked = bookmarks.where("level = 1").groupBy("doc_id", "page").agg(F.min_by("title", "pos" if "pos" in bookmarks.columns else "title").alias("_b"))
    x = prepared.join(named, ["doc_id", "page"], "left").join(marked, ["doc_id", "page"], "left").withColumn("_t", F.coalesce("_b", "_h"))
    x = x.select("doc_id", F.col("page").alias("pos"), F.col("_t").isNotNull().alias("starts"), F.col("html").rlike(BODY).alias("has_body"), "_t", "html")
    numbered = chapter_numbers(x)
    pages = F.array_sort(F.collect_list(F.struct("pos", "html")))  # bounded by one chapter
    out = numbered.groupBy("doc_id", "chapter_no").agg(F.max_by("_t", F.when(F.col("_t").isNotNull(), F.col("pos"))).alias("_t"), F.array_join(F.transform(pages, lambda p: p["html"]), "").alias("html"), F.count("*").alias("n_pages"))
    return out.join(titles.select("doc_id", F.col("title").alias("_book")), "doc_id", "left").select("doc_id", (F.col("chapter_no") + 1).cast("int").alias("chapter_no"), F.coalesce("_t", "_book").alias("title"), "html", "n_pages")


@F.pandas_udf(StringType())
def _relinked(html: pd.Series, places: pd.Series) -> pd.Series:
    def one(markup: str, to) -> str:
        known = dict(to) if to is not None else {}
        return re.sub(r' href="#([^"]*)"', lambda m: f' href="{known[m[1]]}"' if m[1] in known else "", markup)

    return pd.Series([one(m, t) for m, t in zip(html, places, strict=True)])


def anchor_places(parts: DataFrame) -> DataFrame:
    """(doc_id, anchor, chapter_no) of all anchors of ``parts(doc_id, chapter_no, html)``."""
    return parts.select("doc_id", "chapter_no", F.explode(F.regexp_extract_all("html", F.lit(r' id="([^"]+)"'), F.lit(1))).alias("anchor"))


def link_chapters(parts: DataFrame) -> DataFrame:
    """``parts`` with links to anchors of the book as links to their chapter; those that lead nowhere are no links."""
    used = parts.select("doc_id", "chapter_no", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r' href="#([^"]*)"'), F.lit(1)))).alias("anchor"))
    places = anchor_places(parts).groupBy("doc_id", "anchor").agg(F.min("chapter_no").alias("_to"))
    to = F.concat(F.lit("../sections/chapter-"), F.col("_to").cast("string"), F.lit(".xhtml#"), "anchor")
    maps = used.join(places, ["doc_id", "anchor"]).groupBy("doc_id", "chapter_no").agg(F.map_from_entries(F.collect_list(F.struct("anchor", to.alias("to")))).alias("_m"))  # bounded by one chapter
    return parts.join(maps, ["doc_id", "chapter_no"], "left").withColumn("html", _relinked("html", "_m")).select(*parts.columns)


@F.pandas_udf(StringType())
def _contents(items: pd.Series) -> pd.Series:
    """A nested list of (title, level, href) in order."""

    def nested(rows) -> str:
        root: list = []
        stack: list[tuple[int, list]] = [(0, root)]
        for r in rows:
            while len(stack) > 1 and stack[-1][0] >= r["level"]:
                stack.pop()
            node: list = []
            stack[-1][1].append((r, node))
            stack.append((r["level"], node))
        draw = lambda nodes: "<ol>" + "".join(f'<li><a href="{escape(r["href"])}">{escape(r["title"], quote=False)}</a>{draw(own) if own else ""}</li>' for r, own in nodes) + "</ol>"
        return draw(root)

    return items.map(nested)


def contents(prepared: DataFrame, bookmarks: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, toc): the nested list of a book's bookmarks, or headings, at their places; of its chapters if none has a place."""
    targets = book_targets(bookmarks.select("doc_id", "title", "page", "level"), heading_rows(prepared))
    placed = targets.join(anchor_places(parts).withColumnRenamed("anchor", "target"), ["doc_id", "target"])
    href = F.concat(F.lit("sections/chapter-"), F.col("chapter_no").cast("string"), F.lit(".xhtml"))
    rows = placed.select("doc_id", "page", F.regexp_extract("target", r"(\d+)\z", 1).cast("int").alias("n"), "title", "level", F.concat(href, F.lit("#"), "target").alias("href"))
    plain = parts.join(rows.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.col("chapter_no").alias("page"), F.lit(0).alias("n"), "title", F.lit(1).alias("level"), href.alias("href"))
    items = F.array_sort(F.collect_list(F.struct("page", "n", "level", "title", "href")))  # one book's contents
    return rows.unionByName(plain).groupBy("doc_id").agg(items.alias("i")).select("doc_id", _contents("i").alias("toc"))


def _document(title: Column, body: Column, language: Column, css: str) -> Column:
    """One XHTML file."""
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><html {XHTML} lang="'), language, F.lit('"><head><title>'), xml_escape(title), F.lit(f'</title><meta charset="utf-8"/><link rel="stylesheet" type="text/css" href="{css}"/></head><body>'), body, F.lit("</body></html>"))


def book_entries(parts: DataFrame, toc: DataFrame, books: DataFrame, css: str = "body { line-height: 1.5; }") -> DataFrame:
    """(archive, entry_no, path, content): the files of each book of ``books(doc_id, title, author, language)``, from chapters and contents."""
    b = books.select("doc_id", "title", F.col("author"), F.coalesce("language", F.lit("und")).alias("language"))
    file = F.concat(F.lit("sections/chapter-"), F.col("chapter_no").cast("string"), F.lit(".xhtml"))
    name = F.concat(F.lit("chapter-"), F.col("chapter_no").cast("string"))
    order = F.array_sort(F.collect_list(F.struct("chapter_no", name.alias("name"), file.alias("file"))))
    lists = parts.groupBy("doc_id").agg(order.alias("c"))  # names of one book's chapters
    item = F.array_join(F.transform("c", lambda x: F.concat(F.lit('<item id="'), x["name"], F.lit('" href="'), x["file"], F.lit('" media-type="application/xhtml+xml"/>'))), "")
    spine = F.array_join(F.transform("c", lambda x: F.concat(F.lit('<itemref idref="'), x["name"], F.lit('"/>'))), "")
    dc = lambda tag, c: F.concat(F.lit(f"<dc:{tag}>"), xml_escape(c), F.lit(f"</dc:{tag}>"))
    package = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><package version="3.0" xmlns="http://www.idpf.org/2007/opf" unique-identifier="bookid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="bookid">urn:sha:'),
        F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "title"), 256), F.lit("</dc:identifier>"), dc("title", F.col("title")), dc("language", F.col("language")), F.coalesce(dc("creator", F.col("author")), F.lit("")),
        F.lit('</metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="css" href="book.css" media-type="text/css"/>'), item, F.lit("</manifest><spine>"), spine, F.lit('<itemref idref="nav" linear="no"/></spine></package>'),
    )
    whole = b.join(lists, "doc_id").join(toc, "doc_id")
    nav = _document(F.lit("Índice"), F.concat(F.lit('<nav epub:type="toc" id="toc"><h1>Índice</h1>'), "toc", F.lit("</nav>")), F.col("language"), "book.css")
    fixed = [("mimetype", F.lit("application/epub+zip")), ("META-INF/container.xml", F.lit(CONTAINER)), ("OEBPS/book.css", F.lit(css)), ("OEBPS/nav.xhtml", nav), ("OEBPS/content.opf", package)]
    files = F.array(*[F.struct(F.lit(k).alias("entry_no"), F.lit(path).alias("path"), content.alias("content")) for k, (path, content) in enumerate(fixed)])
    front = whole.select(F.col("doc_id").cast("string").alias("archive"), F.inline(files))
    body = parts.join(b.select("doc_id", "language"), "doc_id").select(F.col("doc_id").cast("string").alias("archive"), (F.col("chapter_no") + 100).alias("entry_no"), F.concat(F.lit("OEBPS/"), file).alias("path"), _document(F.col("title"), F.col("html"), F.col("language"), "../book.css").alias("content"))
    return front.unionByName(body).withColumn("content", F.col("content").cast("binary"))


def structured_book(pages: DataFrame, bookmarks: DataFrame, books: DataFrame) -> DataFrame:
    """Entries of the books of ``pages``; see :func:`prepare_pages`, :func:`chapters`, :func:`contents`.

    Prepared pages, chapters and contents are read several times each, so they are written first.
    """
    prepared = materialize(prepare_pages(pages), "2m")
    parts = materialize(chapters(prepared, bookmarks, books.select("doc_id", "title")), "2m")
    toc = materialize(contents(prepared, bookmarks, parts), "2m")
    linked = materialize(link_chapters(parts), "2m")
    release(prepared, parts)
    return book_entries(linked, toc, books)


def simple_book(paragraphs: DataFrame, books: DataFrame) -> DataFrame:
    """Entries of books of plain sections: ``paragraphs(doc_id, section_no, title, pos, text)``, sections from 0. Columns only."""
    lines = F.array_sort(F.collect_list(F.struct("pos", "text")))  # one section
    s = paragraphs.groupBy("doc_id", "section_no", "title").agg(F.array_join(F.transform(lines, lambda p: F.concat(F.lit("<p>"), xml_escape(p["text"]), F.lit("</p>"))), "\n").alias("body"))
    named = s.withColumns({"slug": section_slug(trim_all(F.coalesce("title", F.lit(""))), F.col("section_no") + 1), "chapter_no": F.col("section_no") + 1})
    html = F.concat(F.coalesce(F.concat(F.lit("<h1>"), xml_escape(F.col("title")), F.lit("</h1>")), F.lit("")), "body")
    parts = named.select("doc_id", "chapter_no", F.coalesce("title", "slug").alias("title"), html.alias("html"))
    item = F.concat(F.lit('<li><a href="sections/chapter-'), F.col("chapter_no").cast("string"), F.lit('.xhtml">'), xml_escape(F.col("title")), F.lit("</a></li>"))
    toc = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chapter_no", item.alias("li")))).alias("l")).select("doc_id", F.concat(F.lit("<ol>"), F.array_join(F.transform("l", lambda x: x["li"]), ""), F.lit("</ol>")).alias("toc"))
    return book_entries(parts, toc, books)
