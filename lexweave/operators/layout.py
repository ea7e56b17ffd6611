"""Page layout: lines, paragraphs, headers and footers, sections, headings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.markup import page_facts
from lexweave.functions.replies import without_images
from lexweave.functions.text import trim_all, without_spaces
from lexweave.operators.order import composed_states, numbered, running_sum
from lexweave.session import materialize


def assemble_lines(items: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """``items(doc_id, page, item_no, str, x, y, height)`` → (doc_id, page, line_no, text, y, height).

    Items go from top to bottom (heights rounded to two units), then left to right. An
    item joins a line within ``tolerance`` of the line's first item; a line that
    ends with a hyphen takes the next item without a space. Blank and null items go; without a place they stand at 0, heights are 10
    where there is none, and 1 at least. A page's items are dealt to one task and sorted there; they pass through it one by one,
    so time grows with the items and only one line is held.
    """
    text, y = trim_all(F.col("str")), F.coalesce("y", F.lit(0.0))
    placed = items.select("doc_id", "page", text.alias("text"), y.alias("y"), F.greatest(F.lit(1.0), F.abs(F.coalesce("height", F.lit(10.0)))).alias("height"), (-F.rint(y / 2)).alias("_k"), F.coalesce("x", F.lit(0.0)).alias("_x"), "item_no").where("text <> ''")
    ordered = placed.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "_k", "_x", "item_no").select("doc_id", "page", "text", "y", "height")
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, line, number, top, tall, kind = None, [], 0, 0.0, 0.0, None
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            types = [kind.field(0).type, kind.field(1).type, pa.int32(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "page", "line_no", "text", "y", "height"])

        for b in batches:
            kind = b.schema
            for doc, page, t, at, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last == (doc, page) and abs(at - top) <= tolerance:
                    line.append(t if line[-1].endswith("-") else f" {t}")
                    tall = h if h > tall or h != h else tall
                    continue
                if last is not None:
                    done.append((*last, number, "".join(line), top, tall))
                number = number + 1 if last == (doc, page) else 0
                last, line, top, tall = (doc, page), [t], at, h
            if done:
                yield flush()
                done.clear()
        if last is not None:
            done.append((*last, number, "".join(line), top, tall))
            yield flush()

    return ordered.mapInArrow(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, line_no int, text string, y double, height double")


def joined_with_hyphens(texts: Column) -> Column:
    """Texts joined by spaces; after a hyphen without one. Empty ones are left out."""
    spaced = F.transform(F.filter(texts, lambda t: t != ""), lambda t: F.when(t.endswith("-"), t).otherwise(F.concat(t, F.lit(" "))))
    return F.regexp_replace(F.array_join(spaced, ""), r" \z", "")


def assemble_paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, page, para_no, text): a new paragraph where the gap is over 1.45 heights of the line above, 11 at least."""
    w = Window.partitionBy("doc_id", "page").orderBy("line_no")
    gap = F.lag("y").over(w) - F.col("y")
    starts = (gap > F.greatest(F.lag("height").over(w) * 1.45, F.lit(11.0))).cast("int")
    marked = lines.withColumn("_s", F.coalesce(starts, F.lit(0))).withColumn("para_no", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return marked.groupBy("doc_id", "page", "para_no").agg(joined_with_hyphens(ordered).alias("text"))


def strip_headers(paras: DataFrame, depth: int = 3) -> DataFrame:
    """``paras(doc_id, page, para_no, text)`` without running titles: texts that stand at the same place, among the first ``depth``, on
    every page (two pages at least). Of each page the paragraphs before the first other text go."""
    return _strip_edge(paras, depth, footer=False)


def strip_footers(paras: DataFrame, depth: int = 2) -> DataFrame:
    """The same from the end of each page, where numbers alone go as well, whatever the other pages have."""
    return _strip_edge(paras, depth, footer=True)


def _strip_edge(paras: DataFrame, depth: int, footer: bool) -> DataFrame:
    page = Window.partitionBy("doc_id", "page")
    order = F.desc("para_no") if footer else F.asc("para_no")
    placed = paras.withColumn("_at", F.row_number().over(page.orderBy(order)) - 1).withColumn("_size", F.count("*").over(page)).withColumn("_key", trim_all(F.col("text")))
    pages = placed.groupBy("doc_id").agg(F.count_distinct("page").alias("_pages"), F.min("_size").alias("_least"), F.min("page").alias("_first"))
    number = F.col("_key").rlike(r"\A[0-9]+\z")
    head = placed.where(F.col("_at") < depth).join(pages, "doc_id")
    edge = head.groupBy("doc_id", "_at", "_pages", "_least").agg(F.count("*").alias("_n"), F.min("_key").alias("_a"), F.max("_key").alias("_b"), F.bool_and(number).alias("_num"), F.max(F.when(F.col("page") == F.col("_first"), F.col("_key"))).alias("_key"))
    shared = (F.col("_a") == F.col("_b")) | (F.col("_num") if footer else F.lit(False))
    marks = edge.where((F.col("_pages") >= 2) & (F.col("_n") == F.col("_pages")) & (F.col("_at") < F.col("_least")) & (F.col("_key") != "") & shared).select("doc_id", "_key", F.lit(True).alias("_mark")).distinct()
    joined = placed.join(marks, ["doc_id", "_key"], "left").join(pages.select("doc_id", "_pages"), "doc_id")
    gone = F.coalesce("_mark", F.lit(False)) | (number & (F.col("_pages") >= 2) if footer else F.lit(False))
    seen = F.bool_or(~gone).over(page.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("_seen", seen).where("_seen").select(*paras.columns)


# Lines that open a chapter, and numbers that stand before a title.
CHAPTER_WORD = r"\A(introducci[oó]n|pr[oó]logo|ep[ií]logo|conclusi[oó]n|ap[eé]ndice)\z"
CHAPTER_NUMBER = r"\A(cap[ií]tulo|chapter|parte|part|libro|book)\s+([\divxlcdm]+|[a-záéíóúñ].*)\z"
ROMAN_TITLE = r"\A[ivxlcdm]+[.)]\s+[A-ZÁÉÍÓÚÜÑ0-9][A-ZÁÉÍÓÚÜÑ0-9 \-—]{2,}\z"
NUMBERED = r"(?i)\A(\d{1,3}|[ivxlcdm]+)[.)]\z"
SENTENCE_END = r"[.!?;:]\z"
FRONT, PAGE = "Preliminares", "Página "


def is_chapter(c: Column) -> Column:
    named = c.rlike(f"(?iu){CHAPTER_WORD}") | c.rlike(f"(?iu){CHAPTER_NUMBER}") | c.rlike(ROMAN_TITLE)
    return F.length(c).between(3, 120) & ~c.rlike(SENTENCE_END) & named


def is_upper(c: Column) -> Column:
    """Four letters at least, none of them lower case, 120 characters at most, not the end of a sentence."""
    return (F.length(F.regexp_replace(c, "[^A-Za-zÁÉÍÓÚÜÑáéíóúüñ]", "")) >= 4) & (F.length(c) <= 120) & (F.upper(c) == c) & ~c.rlike(SENTENCE_END)


#: A walk over paragraphs. States: no heading yet, some heading, and the next line may be the first, second or third of a numbered title.
#: Paragraphs: 0 plain, 1 upper case, 2 chapter line, 3 number before an upper-case line, 4 other number; 5 to 8 the last three (and
#: the plain one) when they are upper case themselves.
_PLAIN, _FOUND, _FIRST, _SECOND, _THIRD = range(5)


def _walk(kind: int) -> tuple[int, ...]:
    upper, kind = kind in (1, 6, 7, 8), {6: 2, 7: 3, 8: 4}.get(kind, kind)
    afresh = lambda found: _FIRST if kind == 3 else _FOUND if kind == 2 or found else _PLAIN
    return tuple({_FIRST: _SECOND, _SECOND: _THIRD, _THIRD: _FOUND}[s] if s >= _FIRST and upper else afresh(s != _PLAIN) for s in range(5))


NOTHING = "No se pudo extraer contenido util de esta página."  # fixed value: what stands for a page without text


def split_sections(paras: DataFrame, pages: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """``paras(doc_id, page, pos, text)`` → (doc_id, section_no, title, n_paras, chars): sections with a body.

    Headings: a chapter line; a number or roman numeral with a dot or bracket, which takes one to three
    upper-case lines after it into its title, also such as are numerals; once there was one of these, an upper-case line.
    What stands before the first heading is the front matter. Headings without a body vanish. A document without
    a heading, or without a body, has one section for each page; of ``pages(doc_id, page)`` those without
    paragraphs have a notice instead. The walk over a document's paragraphs is composed from parts, and sections are numbered by
    running sums, so the paragraphs of one document never meet in one task.
    """
    x = paras.withColumn("text", trim_all(F.col("text")))
    # what expressions say of a line is worked out once, before the lines are dealt
    x = x.withColumns({"_upper": is_upper(F.col("text")), "_number": F.col("text").rlike(NUMBERED), "_chapter": is_chapter(F.col("text"))})
    after = F.lead("_upper").over(Window.partitionBy("doc_id").orderBy("pos"))
    plain = F.when(F.col("_number"), F.when(F.coalesce(after, F.lit(False)), 3).otherwise(4)).when(F.col("_chapter"), 2).otherwise(0)
    symbol = F.when(F.col("_upper"), F.when(plain == 0, 1).otherwise(plain + 4)).otherwise(plain)
    x = x.withColumn("_kind", symbol.cast("int")).drop("_upper", "_number", "_chapter")
    x = composed_states(x, "doc_id", ["pos"], "_kind", [_walk(k) for k in range(9)], parts, keep=True)
    kind = F.when(F.col("_kind") > 5, F.col("_kind") - 4).otherwise(F.col("_kind"))
    taken = (F.col("_was") >= _FIRST) & F.col("_kind").isin(1, 6, 7, 8)
    head = ~taken & (kind.isin(2, 3) | ((kind == 1) & (F.col("_was") != _PLAIN)))
    x = x.withColumns({"_co": taken, "_head": head})
    x = materialize(running_sum(x, "_sec", F.col("_head").cast("int"), F.col("doc_id"), F.col("pos"), parts=parts).withColumn("_named", F.col("_head") | F.col("_co")))
    whole = materialize(x.groupBy("doc_id").agg((F.bool_or("_head") & F.bool_or(~F.col("_named"))).alias("_chapters"), F.min(F.col("_sec") - F.col("_head").cast("int")).alias("_base")))
    x = x.join(whole, "doc_id")
    chapters = F.col("_chapters")
    x = x.withColumns({"_sec": F.when(chapters, F.col("_sec") - F.col("_base")).otherwise(F.col("page")), "_named": F.col("_named") & chapters})
    title = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_named"), F.struct("pos", "text")))), lambda t: t["text"]), " ")  # a title's lines, four at most
    out = x.groupBy("doc_id", "_sec", "_chapters").agg(title.alias("title"), F.count_if(~F.col("_named")).alias("n_paras"), F.sum(F.when(~F.col("_named"), F.length("text")).otherwise(0)).alias("chars")).where("n_paras > 0")
    if pages is not None:
        bare = pages.select("doc_id", F.col("page").cast("long").alias("_sec")).join(whole.where("_chapters").select("doc_id"), "doc_id", "left_anti").join(paras.select("doc_id", F.col("page").cast("long").alias("_sec")).distinct(), ["doc_id", "_sec"], "left_anti")
        out = out.unionByName(bare.select("doc_id", "_sec", F.lit(False).alias("_chapters"), F.lit("").alias("title"), F.lit(1).cast("long").alias("n_paras"), F.lit(len(NOTHING)).cast("long").alias("chars")))
    title = F.when(~chapters, F.concat(F.lit(PAGE), F.col("_sec").cast("string"))).when(F.col("_sec") == 0, FRONT).otherwise(F.col("title"))
    named = out.withColumn("title", title)
    return numbered(named, "section_no", F.col("_sec"), within="doc_id").select("doc_id", F.col("section_no").cast("int").alias("section_no"), "title", "n_paras", "chars")


def repeated_pages(pages: DataFrame, least: int = 300) -> DataFrame:
    """``pages(doc_id, page, text, source_text)`` with ``is_repeat``: the text of the page before, white space apart, though the two
    sources differ; texts and both sources have more than ``least`` characters."""
    w = Window.partitionBy("doc_id").orderBy("page")
    bare = pages.withColumn("_t", without_spaces(F.col("text")))
    previous = F.lag(F.struct("page", "_t", "source_text")).over(w)
    long = (F.length("_t") > least) & (F.length("source_text") > least) & (F.length(previous["source_text"]) > least)
    same = (previous["page"] == F.col("page") - 1) & (F.col("_t") == previous["_t"]) & (F.col("source_text") != previous["source_text"]) & long
    return bare.withColumn("is_repeat", F.coalesce(same, F.lit(False))).select(*pages.columns, "is_repeat")


def coverage(pages: DataFrame, least: int = 500, share: float = 0.55) -> DataFrame:
    """``pages(doc_id, source_text, output_text)`` per document: characters in and out without white space and linked images, and
    ``is_rejected`` where too little came out."""
    size = lambda c: F.length(without_spaces(c))
    source = without_images(F.coalesce("source_text", F.lit("")))
    out = pages.groupBy("doc_id").agg(F.sum(size(source)).alias("source_chars"), F.sum(size(F.coalesce("output_text", F.lit("")))).alias("output_chars"))
    return out.withColumn("is_rejected", (F.col("source_chars") > least) & (F.col("output_chars") < F.col("source_chars") * share))


def heading_parents(headings: DataFrame, deepest: int = 6) -> DataFrame:
    """``headings(doc_id, pos, level)`` with ``parent_pos``: the nearest earlier heading of a smaller level."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("level") > k, F.last_value(F.when(F.col("level") == k, F.col("pos")), ignoreNulls=F.lit(True)).over(w)) for k in range(1, deepest)]
    return headings.withColumn("parent_pos", F.greatest(*last) if len(last) > 1 else last[0])


def chapter_numbers(marks: DataFrame) -> DataFrame:
    """``marks(doc_id, pos, starts, has_body)`` with ``chapter_no``: a start only opens a chapter if the one before has a body."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    seg = marks.withColumn("_g", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    body = seg.groupBy("doc_id", "_g").agg(F.bool_or("has_body").alias("_b"))
    body = body.withColumn("chapter_no", F.coalesce(F.sum(F.col("_b").cast("int")).over(Window.partitionBy("doc_id").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return seg.join(body.select("doc_id", "_g", "chapter_no"), ["doc_id", "_g"]).select(*marks.columns, "chapter_no")


def contiguous_prefix(done: DataFrame, key: str, page: str = "page") -> DataFrame:
    """Per ``key``: how many pages from 1 on are there without a gap."""
    w = Window.partitionBy(key).orderBy(page)
    numbered = done.select(key, page).distinct().withColumn("_n", F.row_number().over(w))
    return numbered.groupBy(key).agg(F.count_if(F.col("_n") == F.col(page)).alias("n_contiguous"), F.count("*").alias("n_done"))


def page_batches(pages: DataFrame, done: DataFrame, size: int = 3) -> DataFrame:
    """Pending pages with the number of their fixed range of ``size`` pages."""
    left = pages.join(done.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    return left.withColumn("batch_no", F.floor((F.col("page") - 1) / F.lit(size)).cast("int"))


def ocr_paragraphs(lines: DataFrame) -> DataFrame:
    """``lines(doc_id, page, line_no, text)`` → (doc_id, page, para_no, text): blank lines part paragraphs; after a hyphen no space."""
    w = Window.partitionBy("doc_id", "page").orderBy("line_no")
    x = lines.withColumn("text", trim_all(F.col("text")))
    x = x.withColumn("_g", F.sum((F.col("text") == "").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("text <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda t: t["text"])
    out = x.groupBy("doc_id", "page", "_g").agg(joined_with_hyphens(ordered).alias("text"))
    return out.select("doc_id", "page", (F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("_g")) - 1).cast("int").alias("para_no"), "text")


def preview_budget(items: DataFrame, budget: int = 2000) -> DataFrame:
    """``items(doc_id, pos, text)``: the first ``budget`` characters of each document, the last item cut."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    return items.withColumn("_b", before).where(F.col("_b") < budget).select("doc_id", "pos", F.left("text", F.lit(budget) - F.col("_b")).alias("text"))


def join_across_pages(blocks: DataFrame) -> DataFrame:
    """``blocks(doc_id, pos, text, continues, join_word)``: a block that continues joins the one before it, without a space (and hyphen) if a word was cut."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    x = blocks.withColumn("_i", F.sum((~F.col("continues")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text", "join_word")))
    text = F.aggregate(ordered, F.lit(""), lambda acc, b: F.when(acc == "", b["text"]).when(b["join_word"], F.concat(F.regexp_replace(acc, r"-\z", ""), b["text"])).otherwise(F.concat(acc, F.lit(" "), b["text"])))
    return x.groupBy("doc_id", "_i").agg(F.min("pos").alias("pos"), text.alias("text")).select("doc_id", "pos", "text")


def needs_ocr(text: Column, least: int = 40) -> Column:
    return F.length(F.regexp_replace(text, r"\W", "")) < least


def needs_ocr_preview(text: Column, least: int = 40) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) < least


FIGURES = "array<struct<id:string,alt:string,x:double,y:double,width:double,height:double>>"


def is_fraction_box(f: Column, slack: float = 0.001) -> Column:
    """Whether a figure's box is finite, not empty and inside the page."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    inside = (f["x"] >= 0) & (f["y"] >= 0) & (f["width"] > 0) & (f["height"] > 0) & (f["x"] + f["width"] <= 1 + slack) & (f["y"] + f["height"] <= 1 + slack)
    return F.coalesce(finite(f["x"]) & finite(f["y"]) & finite(f["width"]) & finite(f["height"]) & inside, F.lit(False))


def is_trustworthy(c: Column) -> Column:
    """Whether a source text is fit to measure by: no damaged characters, and letters and digits are most of it."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return ~c.rlike("[\ufffd\\x00]") & (letters > F.length(without_spaces(c)) * 0.6)


def page_reason(pages: DataFrame, most_figures: int = 16) -> DataFrame:
    """``pages(expected, page, html, continues_previous, join_previous_word, is_toc, is_blank, figures, source_text)`` with ``reason``:
    the first check that fails, else null. Lengths are those of the text without white space, after the markup was made safe."""
    figures, ids, refs = F.coalesce("figures", F.array().cast(FIGURES)), F.col("_ids"), F.col("_refs")
    x = pages.withColumns({"_figures": figures, "_ids": F.transform(figures, lambda f: f["id"]), "_facts": page_facts(F.col("page"), F.col("html"), figures)})
    x = x.withColumns({"_refs": F.col("_facts.references"), "_n": F.length(without_spaces(F.col("_facts.text"))), "_source": F.coalesce("source_text", F.lit(""))})
    n, source = F.col("_n"), F.col("_source")
    typed = F.col("html").isNotNull() & F.col("continues_previous").isNotNull() & F.col("join_previous_word").isNotNull() & F.col("is_toc").isNotNull() & F.col("is_blank").isNotNull()
    framed = F.coalesce((F.col("page") == F.col("expected")) & typed & ~(F.col("join_previous_word") & ~F.col("continues_previous")), F.lit(False))
    sound = F.forall("_figures", lambda f: F.coalesce(f["id"].rlike(r"\Afig-[0-9]+\z"), F.lit(False)) & f["alt"].isNotNull() & is_fraction_box(f)) & (F.size(F.array_distinct(ids)) == F.size(ids))
    bound = (F.size(refs) == F.size(ids)) & (F.size(F.array_distinct(refs)) == F.size(refs)) & (F.size(F.array_except(refs, ids)) == 0)
    damaged = F.length("html") - F.length(F.replace(F.col("html"), F.lit("\ufffd"), F.lit("")))  # as the page came, dropped elements too
    original = F.length(without_spaces(source))
    reason = (
        F.when(~framed, "structure")
        .when(F.size("_figures") > most_figures, "figures")
        .when(~sound, "figure")
        .when(~bound, "references")
        .when(F.when(F.col("is_blank"), (n > 0) | (F.size("_figures") > 0)).otherwise((n == 0) & (F.size("_figures") == 0)), "blank")
        .when(damaged > F.greatest(F.lit(2), n * 0.005), "damaged")
        .when(is_trustworthy(source) & (original >= 300) & (n < original * 0.65), "coverage")
    )
    return x.withColumn("reason", reason).select(*pages.columns, "reason")
