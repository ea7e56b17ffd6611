"""Book catalogues: cleaned candidates, interleaving of ranked lists, and merging of records of one book."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import blank_to_null, normalized_isbn

CANDIDATE = "query_id long, pos int, open_library_key string, title string, authors array<string>, isbn string, cover_url string, first_publish_year int, categories array<string>"
#: Fixed value: the title of a record that has none.
PLACEHOLDER = "Sin título"


def clean_candidates(rows: DataFrame, per_source: int = 12, categories: int = 8) -> DataFrame:
    """``rows`` with blanks as nulls, ISBNs normalised, https covers, and categories without repeats."""
    names = lambda c: F.filter(F.transform(c, blank_to_null), lambda x: x.isNotNull())
    return rows.where(F.col("pos") < per_source).withColumns(
        {
            "title": F.coalesce(blank_to_null(F.col("title")), F.lit(PLACEHOLDER)),
            "authors": names(F.coalesce("authors", F.array().cast("array<string>"))),
            "isbn": normalized_isbn(F.col("isbn")),
            "cover_url": F.regexp_replace("cover_url", r"\Ahttp:", "https:"),
            "categories": F.slice(F.array_distinct(names(F.coalesce("categories", F.array().cast("array<string>")))), 1, categories),
        }
    )


def interleave(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two ranked lists per query as one: first of either, second of either, and so on."""
    both = first.withColumn("_s", F.lit(0)).unionByName(second.withColumn("_s", F.lit(1)))
    w = Window.partitionBy("query_id").orderBy("pos", "_s")
    return both.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).drop("_s")


def _folded(text: str) -> str:
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not 0x300 <= ord(c) <= 0x36F)
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def signature(title: str, authors: list[str]) -> str | None:
    """Title and first author, folded; None where both leave nothing to compare."""
    both = f"{_folded(title)}|{_folded(authors[0] if authors else '')}"
    return None if both == "|" else both


def fold_candidates(records: Iterable[dict], categories: int = 8) -> list[dict]:
    """The merged records of one query's candidates, in order of first appearance."""
    merged: list[dict] = []
    by_isbn: dict[str, int] = {}
    by_signature: dict[str, int] = {}
    for r in records:
        r = {**r, "title": r["title"] or PLACEHOLDER, "authors": r["authors"] or [], "categories": r["categories"] or []}
        at = by_isbn.get(r["isbn"]) if r["isbn"] else None
        if at is None:
            at = by_signature.get(signature(r["title"], r["authors"]))
        if at is None:
            at = len(merged)
            merged.append({**r, "n_sources": 1})
        else:
            m = merged[at]
            m["n_sources"] += 1
            if m["title"] == PLACEHOLDER:
                m["title"] = r["title"]
            for k in ("open_library_key", "isbn", "cover_url", "first_publish_year"):
                m[k] = r[k] if m[k] is None else m[k]
            m["authors"] = m["authors"] or r["authors"]
            m["categories"] = list(dict.fromkeys(m["categories"] + r["categories"]))[:categories]
        if merged[at]["isbn"]:
            by_isbn[merged[at]["isbn"]] = at
        by_signature[signature(merged[at]["title"], merged[at]["authors"])] = at
        by_signature.pop(None, None)
    return merged


def merge_candidates(rows: DataFrame, limit: int = 18, categories: int = 8) -> DataFrame:
    """One row per book and query, in order of first appearance.

    A record joins the merged one that its ISBN leads to, else its signature, and fills
    in what that one lacks. Then the ISBN and signature of the merged record lead there. The
    order matters, so a query's candidates (two lists that :func:`clean_candidates` cut) are
    one fold. Queries stream through a task in order, so it holds one query's records at a time.
    A missing title counts as the placeholder, missing lists as empty; an empty table gives no rows.
    """
    names = [c.split()[0] for c in CANDIDATE.split(", ")]
    schema = pa.schema([("query_id", pa.int64()), ("pos", pa.int32()), *[(k, pa.string()) for k in names[2:4]], ("authors", pa.list_(pa.string())), ("isbn", pa.string()), ("cover_url", pa.string()), ("first_publish_year", pa.int32()), ("categories", pa.list_(pa.string())), ("n_sources", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (r for b in batches for r in b.to_pylist())
        out: list[dict] = []
        for _, query in groupby(records, key=itemgetter("query_id")):
            out += [{**m, "pos": i} for i, m in enumerate(fold_candidates(query, categories)[:limit])]
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    typed = rows.selectExpr(*[f"cast({k} as {t}) as {k}" for k, t in (c.split() for c in CANDIDATE.split(", "))])
    return typed.repartition("query_id").sortWithinPartitions(*names).mapInArrow(run, CANDIDATE + ", n_sources int")


#: Types of a glossary entry.
TERM_TYPES = ("name", "place", "term", "title")


def glossary(entries: DataFrame, key: str = "doc_id", limit: int = 100) -> DataFrame:
    """``entries(key, pos, source, target, type)``: trimmed, other types as ``term``, first of each source whatever its case, ``limit`` at most."""
    clean = entries.withColumns({"source": blank_to_null(F.col("source")), "target": blank_to_null(F.col("target")), "type": F.when(F.col("type").isin(*TERM_TYPES), F.col("type")).otherwise("term")})
    clean = clean.where("source is not null and target is not null")
    first = clean.withColumn("_n", F.row_number().over(Window.partitionBy(key, F.lower("source")).orderBy("pos"))).where("_n = 1")
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("_r") <= limit).select(key, "pos", "source", "target", "type")


def user_glossary_is_valid(entries: DataFrame, key: str = "doc_id", limit: int = 100, longest: int = 300) -> DataFrame:
    """A user's list is taken or rejected as a whole."""
    bad = F.count_if(F.coalesce(blank_to_null(F.col("source")).isNull() | blank_to_null(F.col("target")).isNull() | (F.length("source") > longest) | (F.length("target") > longest), F.lit(True)))
    out = entries.groupBy(key).agg(F.count("*").alias("n"), bad.alias("n_bad"), F.count_distinct(F.lower("source")).alias("n_sources"))
    return out.select(key, ((F.col("n") <= limit) & (F.col("n_bad") == 0) & (F.col("n") == F.col("n_sources"))).alias("is_valid"))
