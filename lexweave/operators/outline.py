"""Outlines and metadata of documents that other tools have parsed: bookmarks by level, fields by precedence, keyed binary fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lexweave.functions.text import blank_to_null, imported_title, trim_all
from lexweave.operators.order import running_sum
from lexweave.session import materialize, release


#: Items with titles that are joined in a task, about.
PART_ROWS = 100_000


def _doubled(links: DataFrame) -> DataFrame:
    """``links(doc_id, node, up, level, size, walk)`` with sums over all ancestors, by doubling: each round every node looks as far again as it
    has so far, so a chain of n items takes log2(n) rounds.

    ``level`` and ``walk`` sum along the way up. Nodes that never reach a root (a missing parent, a cycle) go.
    """
    rounds = int(links.count()).bit_length() + 1
    for _ in range(rounds):
        above = links.select(F.col("doc_id").alias("_d"), F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("level").alias("_level"), F.col("walk").alias("_walk"))
        met = links.where("up is not null").join(above, (F.col("doc_id") == F.col("_d")) & (F.col("up") == F.col("_n")))
        step = met.select("doc_id", "node", F.col("_up").alias("up"), (F.col("level") + F.col("_level")).alias("level"), (F.col("walk") + F.col("_walk")).alias("walk"))
        last, links = links, materialize(links.where("up is null").unionByName(step))
        release(last)
        if links.where("up is not null").isEmpty():
            break
    return links.where("up is null").drop("up")


def _subtrees(links: DataFrame) -> DataFrame:
    """``links(doc_id, node, up, size)`` → (doc_id, node, size): the sum of the sizes below each, its own included, by doubling."""
    now = materialize(links)
    for _ in range(int(now.count()).bit_length() + 1):
        below = now.where("up is not null").groupBy("doc_id", F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        above = now.select(F.col("doc_id").alias("_d"), F.col("node").alias("_n"), F.col("up").alias("_up"))
        far = now.join(above, (F.col("doc_id") == F.col("_d")) & (F.col("up") == F.col("_n")), "left").select("doc_id", "node", F.col("_up").alias("up"), "size")
        last, now = now, materialize(far.join(below, ["doc_id", "node"], "left").select("doc_id", "node", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        release(last)
        if now.where("up is not null").isEmpty():
            break
    return now.drop("up")


def flatten_outline(items: DataFrame, n_pages: DataFrame) -> DataFrame:
    """``items(doc_id, item_id, parent_id, pos, title, page)`` → (doc_id, place, title, page, level): depth first, in order of ``pos``, to any depth.

    ``page`` is null for broken or external targets; these and blank titles or pages out of range are left out, their
    children stay. ``place`` counts all items of a document before it, from 0. An item stands after its parent, the
    parent's earlier children and all below those: subtree sizes and sums along the way up give its place, each in
    logarithmic rounds of joins on the item, so neither a long chain nor a long list of children meets in one task. Items
    without children stay out of the rounds and follow their parents at the end. Items
    whose parents are missing, or that are their own ancestors, are never reached and go; so do null ids. Item ids are unique in a document.
    """
    tree = materialize(items.where("doc_id is not null and item_id is not null").select("doc_id", F.col("item_id").alias("node"), F.col("parent_id").alias("up"), "pos", "title", "page"))
    links = tree.select("doc_id", "node", "up", "pos")
    kids = links.where("up is not null").groupBy("doc_id", F.col("up").alias("node")).agg(F.count("*").alias("_kids"))
    marked = materialize(links.join(kids, ["doc_id", "node"], "left"))
    leaves, inner = marked.where("_kids is null").drop("_kids"), marked.where("_kids is not null").drop("_kids")
    ends = leaves.where("up is not null").groupBy("doc_id", F.col("up").alias("node")).agg(F.count("*").alias("_ends"))
    sizes = _subtrees(inner.drop("pos").join(ends, ["doc_id", "node"], "left").select("doc_id", "node", "up", (F.coalesce("_ends", F.lit(0)) + 1).alias("size")))
    sized = inner.join(sizes, ["doc_id", "node"]).withColumn("_leaf", F.lit(False)).unionByName(leaves.withColumns({"size": F.lit(1).cast("long"), "_leaf": F.lit(True)}))
    running = running_sum(sized, "so_far", F.col("size"), F.col("doc_id"), F.col("up").asc_nulls_first(), F.col("pos"), F.col("node"))
    running = materialize(running.select("doc_id", "node", "up", "_leaf", (F.col("so_far") - F.col("size")).alias("before")))
    first = materialize(running.groupBy(F.col("doc_id").alias("_d"), F.col("up").alias("_u")).agg(F.min("before").alias("_first")))  # of each list of children
    elder = running.join(first, (F.col("doc_id") == F.col("_d")) & F.col("up").eqNullSafe(F.col("_u"))).select("doc_id", "node", "up", "_leaf", F.lit(1).alias("level"), (F.col("before") - F.col("_first") + F.when(F.col("up").isNull(), 0).otherwise(1)).alias("walk"))
    elder = materialize(elder)
    above = _doubled(elder.where("not _leaf").drop("_leaf"))
    release(marked, running, first)
    end = elder.where("_leaf").drop("_leaf")
    over = above.select(F.col("doc_id").alias("_d"), F.col("node").alias("_n"), F.col("level").alias("_level"), F.col("walk").alias("_walk"))
    below = end.join(over, (F.col("doc_id") == F.col("_d")) & (F.col("up") == F.col("_n"))).select("doc_id", "node", (F.col("level") + F.col("_level")).alias("level"), (F.col("walk") + F.col("_walk")).alias("walk"))
    placed = above.unionByName(end.where("up is null").drop("up")).unionByName(below)
    # titles are dealt and sorted once, in parts whose size doesn't grow with the items
    shown = tree.select("doc_id", "node", blank_to_null(F.col("title")).alias("title"), "page").where("title is not null and page >= 1")
    parts = max(int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tree.count() // PART_ROWS))
    narrow = placed.join(n_pages.select("doc_id", "n_pages"), "doc_id").repartition(parts, "doc_id", "node")
    kept = narrow.join(shown.repartition(parts, "doc_id", "node"), ["doc_id", "node"]).where("page <= n_pages")
    return kept.select("doc_id", F.col("walk").alias("place"), "title", "page", "level")


def document_metadata(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, xmp, info, catalog_lang)``: fields of the embedded packet first, then of the information dictionary; the language
    from the packet, else the catalogue. ``xmp`` and ``info`` are structs with title, author, description, publisher (and language)."""
    first = lambda name: F.coalesce(blank_to_null(F.col("xmp")[name]), blank_to_null(F.col("info")[name]), F.lit(""))
    language = F.coalesce(blank_to_null(F.col("xmp")["language"]), blank_to_null(F.col("catalog_lang")), F.lit(""))
    return rows.select("doc_id", first("title").alias("title"), first("author").alias("author"), first("description").alias("description"), first("publisher").alias("publisher"), language.alias("language"))


# Where a title block begins and ends, and the names of its fields.
BLOCK, BLOCK_END = b"kindle_title_metadata", b"kindle_ebook_metadata"
KEYS = tuple("book_id override_kindle_font cover_image author description issue_date content_id cde_content_type publisher ASIN language title is_sample asset_id kindle_ebook_metadata kindle_audit_metadata".split())
TAIL, WINDOW = 3 << 20, 256 << 10


@F.pandas_udf(ArrayType(StructType([StructField("key", StringType()), StructField("text", StringType())])))
def _fields(content: pd.Series) -> pd.Series:
    """Known fields of a title block: a field's bytes reach to the next field's name."""

    def read(raw: bytes | None) -> list[tuple[str, str]]:
        at = -1 if raw is None else raw.find(BLOCK)
        if at < 0:
            return []
        stop = raw.find(BLOCK_END, at + 1)
        stop = stop if stop > at else min(len(raw), at + WINDOW)
        places = sorted((p, k) for k in KEYS if 0 <= (p := raw.find(k.encode(), at + len(BLOCK))) < stop)
        ends = [*(p for p, _ in places[1:]), stop]
        return [(k, raw[p + len(k) : e].decode("utf-8", "replace")) for (p, k), e in zip(places, ends, strict=True)]

    return content.map(read)


def readable_run(c: Column) -> Column:
    """The longest run of readable characters."""
    runs = F.regexp_extract_all(c, F.lit(r"""[\p{IsLatin}\p{N}][\p{IsLatin}\p{N}\p{M}\s.,;:!?¿¡'’"“”«»&()_\-–—/]+"""), F.lit(0))
    return F.aggregate(F.transform(runs, trim_all), F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def keyed_metadata(files: DataFrame) -> DataFrame:
    """``files(path, content)`` of books with keyed binary metadata → (path, title, authors), from the last 3 MiB."""
    fields = F.map_from_entries(_fields(F.substring("content", -TAIL, TAIL)))
    value = lambda key: readable_run(F.coalesce(F.try_element_at(fields, F.lit(key)), F.lit("")))
    author = trim_all(F.regexp_replace(F.replace(value("author"), F.lit("_"), F.lit(" ")), r"\s+", " "))
    return files.select("path", F.nullif(imported_title(value("title")), F.lit("")).alias("title"), F.when(author != "", F.array(author)).otherwise(F.array().cast("array<string>")).alias("authors"))
