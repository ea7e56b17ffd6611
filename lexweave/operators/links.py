"""Links: contents entries, bookmarks and anchors to their targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import title_key, without_page_number


def bookmark_targets(bookmarks: DataFrame, headings: DataFrame) -> DataFrame:
    """``bookmarks(doc_id, title, page)`` with ``target``: the first heading of that page and title, else the page."""
    h = headings.withColumn("_k", title_key(F.col("title"))).withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "page", "_k").orderBy("pos"))).where("_n = 1")
    joined = bookmarks.withColumn("_k", title_key(F.col("title"))).join(h.select("doc_id", "page", "_k", "anchor"), ["doc_id", "page", "_k"], "left")
    return joined.select(*bookmarks.columns, F.coalesce("anchor", F.concat(F.lit("page-"), F.col("page").cast("string"))).alias("target"))


def book_targets(bookmarks: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, title, page, level, target): a document's bookmarks at their targets, or its headings where it has no bookmark."""
    own = headings.join(bookmarks.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "title", "page", "level", F.col("anchor").alias("target"))
    return bookmark_targets(bookmarks.select("doc_id", "title", "page", "level"), headings).unionByName(own)


def toc_links(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """``entries(doc_id, entry_no, text)`` with ``target``: the only target of that title; without its page number if there is none."""
    t = targets.groupBy("doc_id", title_key(F.col("title")).alias("_k")).agg(F.count("*").alias("_n"), F.min("anchor").alias("_a"))
    t = t.where("_k <> ''")
    plain = t.select("doc_id", F.col("_k").alias("_k1"), F.col("_n").alias("_n1"), F.col("_a").alias("_a1"))
    short = t.select("doc_id", F.col("_k").alias("_k2"), F.col("_n").alias("_n2"), F.col("_a").alias("_a2"))
    e = entries.withColumns({"_k1": title_key(F.col("text")), "_k2": title_key(without_page_number(F.col("text")))})
    joined = e.join(plain, ["doc_id", "_k1"], "left").join(short, ["doc_id", "_k2"], "left")
    target = F.when(F.col("_n1") == 1, F.col("_a1")).when(F.col("_n1").isNull() & (F.col("_n2") == 1), F.col("_a2"))
    return joined.select(*entries.columns, target.alias("target"))


def resolve_anchors(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """``links(doc_id, link_no, href)`` with ``resolved``: ``chapter#anchor``; null for a fragment that leads nowhere; other links as they are."""
    a = anchors.groupBy("doc_id", "anchor").agg(F.min("chapter").alias("_c"))
    inner = F.col("href").startswith("#")
    joined = links.withColumn("anchor", F.when(inner, F.expr("substring(href, 2)"))).join(a, ["doc_id", "anchor"], "left")
    return joined.select(*links.columns, F.when(~inner, F.col("href")).when(F.col("_c").isNotNull(), F.concat(F.col("_c"), F.col("href"))).alias("resolved"))


def duplicate_anchors(anchors: DataFrame) -> DataFrame:
    return anchors.groupBy("doc_id", "anchor").agg(F.count("*").alias("n")).where("n > 1")


def missing_assets(references: DataFrame, assets: DataFrame) -> DataFrame:
    """(doc_id, path) of references that no asset answers, each once; a null in either is never answered.

    Both sides are counted under one key: one table of keys in a task, not one for each side and two sorts for a join.
    """
    both = references.select("doc_id", "path", F.lit(0).alias("_there")).unionByName(assets.where("doc_id is not null and path is not null").select("doc_id", "path", F.lit(1).alias("_there")))
    return both.groupBy("doc_id", "path").agg(F.max("_there").alias("_there")).where("_there = 0").drop("_there")


def figure_mismatch(page: DataFrame) -> DataFrame:
    """``page(doc_id, used, declared)`` arrays with what only one side has."""
    return page.withColumns({"undeclared": F.array_except("used", "declared"), "unused": F.array_except("declared", "used")})
