"""Previews and preflight: sample chapters, formats, warnings, figures that are whole covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import JS_SPACE, trim_all
from lexweave.operators.layout import needs_ocr_preview

# Entries that are no chapters, and words that head a table of contents.
NO_CHAPTER = r"(?i)(?:\A|/)(?:nav|toc|cover|titlepage)(?:\.[^/]*)?\z"
CONTENTS = r"(?i)(?:table of contents|contents|índice|indice|contenido|sommaire|inhaltsverzeichnis)"


def is_chapter_entry(path: Column) -> Column:
    return path.rlike(r"(?i)\.(?:xhtml|html|htm)\z") & ~path.rlike(NO_CHAPTER)


def sample_items(chapters: DataFrame, budget: int = 2000) -> DataFrame:
    """``chapters(doc_id, entry_no, path, nodes)`` (texts of the body's children) → (doc_id, path, pos, text, n_chapters): the first chapter
    with text, up to ``budget`` characters, the last one cut."""
    one = F.filter(F.transform("nodes", lambda x: trim_all(F.regexp_replace(x, f"[{JS_SPACE}]+", " "))), lambda x: x != "")
    kept = chapters.where(is_chapter_entry(F.col("path"))).withColumn("nodes", one)
    picked = kept.groupBy("doc_id").agg(F.count("*").alias("n_chapters"), F.min(F.when(F.size("nodes") > 0, F.struct("entry_no", "path", "nodes"))).alias("c")).where("c is not null")
    each = picked.select("doc_id", "n_chapters", "c.path", F.posexplode("c.nodes").alias("pos", "text"))
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = each.withColumn("_b", before).where(F.col("_b") < budget)
    return cut.select("doc_id", "path", "pos", F.left("text", F.lit(budget) - F.col("_b")).alias("text"), "n_chapters")


def sample_totals(items: DataFrame, chapters: DataFrame) -> DataFrame:
    """(doc_id, n_items, chars, text_chars): what the sample holds, and the characters of all chapter entries as they are."""
    long = F.aggregate("nodes", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.length(x), F.lit(0)))
    whole = chapters.where(is_chapter_entry(F.col("path"))).groupBy("doc_id").agg(F.sum(long).alias("text_chars"))
    return items.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sum(F.length("text")).alias("chars")).join(whole, "doc_id")


def sample_results(items: DataFrame, translated: DataFrame) -> DataFrame:
    """Items beside their translations; an empty text where there is none."""
    return items.join(translated.select("doc_id", "pos", "translated"), ["doc_id", "pos"], "left").withColumn("translated", F.coalesce("translated", F.lit("")))


def document_format(name: Column, head: Column) -> Column:
    """``pdf``, ``epub`` or null: by extension, and a PDF needs its mark in the first 1,024 bytes."""
    marked = F.instr(F.decode(F.substring(head, 1, 1024), "ISO-8859-1"), "%PDF-") > 0
    return F.when(F.lower(name).endswith(".pdf") & marked, "pdf").when(F.lower(name).endswith(".epub"), "epub")


def is_full_page_cover(page: Column, figures: Column, text: Column) -> Column:
    """Whether a first page is one figure over nearly all of it, with little text."""
    f = F.get(figures, F.lit(0))
    return F.coalesce((page == 1) & (F.size(figures) == 1) & (f["width"] * f["height"] >= 0.95) & (F.length(text) < 400), F.lit(False))


def preview_warnings(pages: DataFrame, bookmarks: DataFrame, most: int = 3) -> DataFrame:
    """``pages(doc_id, page, text)`` → (doc_id, toc_in_sample, warnings), over the first ``most`` pages."""
    sample = pages.where(F.col("page") <= most)
    seen = sample.groupBy("doc_id").agg(F.bool_or(F.lower("text").rlike(CONTENTS)).alias("toc_in_sample"), F.bool_or(needs_ocr_preview(F.col("text"))).alias("_ocr"))
    marked = seen.join(bookmarks.select("doc_id").distinct().withColumn("_b", F.lit(True)), "doc_id", "left")
    found = F.array(F.when(F.col("_b").isNull(), "no-bookmarks"), F.when(~F.col("toc_in_sample"), "no-index-in-sample"), F.when(F.col("_ocr"), "ocr-needed"))
    return marked.select("doc_id", "toc_in_sample", F.array_compact(found).alias("warnings"))


def preflight(settings: DataFrame, usage: DataFrame) -> DataFrame:
    """``settings(scope, provider, mode, model, max_requests)`` beside what each scope has used, and what is left."""
    used = usage.groupBy("scope").agg(F.sum("requests").alias("used_requests"))
    joined = settings.join(used, "scope", "left").withColumn("used_requests", F.coalesce("used_requests", F.lit(0)))
    return joined.withColumns({"left_requests": F.greatest(F.col("max_requests") - F.col("used_requests"), F.lit(0)), "model": F.nullif(trim_all(F.col("model")), F.lit(""))})
