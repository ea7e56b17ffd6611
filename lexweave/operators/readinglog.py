"""Reading log: filters, months, years, counts, and changes of status."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import is_reading_date, search_key, trim_all


def filter_books(books: DataFrame, status: str | None = None, year: str | None = None, query: str = "") -> DataFrame:
    """Books of a status, finished in a year, whose title, authors or categories contain the query (case folded, accents kept)."""
    if status:
        books = books.where(F.col("status") == status)
    if year:
        books = books.where(F.col("finished_at").startswith(year))
    needle = F.lower(trim_all(F.lit(query)))
    text = F.lower(F.concat_ws(" ", "title", "authors", "categories"))
    return books.where(text.contains(needle)) if query.strip() else books


def months(books: DataFrame) -> DataFrame:
    """(month, n_books) in order; books without a date last as ``undated``."""
    m = books.groupBy(F.coalesce(F.left("finished_at", F.lit(7)), F.lit("undated")).alias("month")).agg(F.count("*").alias("n_books"))
    return m.orderBy((F.col("month") == "undated").asc(), "month")


def years(books: DataFrame) -> DataFrame:
    return books.where("finished_at is not null").select(F.left("finished_at", F.lit(4)).alias("year")).distinct().orderBy(F.desc("year"))


def monthly_activity(spark: SparkSession, books: DataFrame, year: str) -> DataFrame:
    """Books read in each of the twelve months of a year, zeros included."""
    read = books.where((F.col("status") == "read") & F.col("finished_at").startswith(year))
    n = read.groupBy(F.substring("finished_at", 6, 2).cast("int").alias("month")).agg(F.count("*").alias("n"))
    return spark.range(1, 13).select(F.col("id").cast("int").alias("month")).join(n, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n_books"))


def status_counts(books: DataFrame, statuses: tuple[str, ...] = ("read", "reading", "to-read", "abandoned")) -> DataFrame:
    names = {s: "n_" + s.replace("-", "_") for s in statuses}
    return books.agg(F.count("*").alias("n_all"), *[F.count_if(F.col("status") == s).alias(n) for s, n in names.items()])


def valid_books(books: DataFrame) -> Column:
    """Domain of a stored book."""
    dates = [F.col(c).isNull() | is_reading_date(F.col(c)) for c in ("started_at", "finished_at")]
    rated = F.col("rating").isNull() | F.col("rating").between(1, 5)
    return (F.length(trim_all(F.col("title"))) > 0) & F.col("status").isin("to-read", "reading", "read", "abandoned") & rated & dates[0] & dates[1]


def change_status(books: DataFrame, patch: DataFrame, now: str) -> DataFrame:
    """``patch(id, status, finished_at, has_finished)``: reading starts a book, read finishes it unless the patch itself speaks of the date."""
    p = patch.select("id", F.col("status").alias("_s"), F.col("finished_at").alias("_f"), F.col("has_finished").alias("_h"))
    b = books.join(p, "id", "left")
    status = F.coalesce("_s", "status")
    started = F.when((F.col("_s") == "reading") & F.col("started_at").isNull(), F.lit(now)).otherwise(F.col("started_at"))
    finished = F.when(F.col("_h"), F.col("_f")).when((F.col("_s") == "read") & F.col("finished_at").isNull(), F.lit(now)).otherwise(F.col("finished_at"))
    return b.withColumns({"status": status, "started_at": started, "finished_at": finished}).select(*books.columns)


def latest_rows(log: DataFrame, key: str = "id", version: str = "version", deleted: str = "is_deleted") -> DataFrame:
    """State of an append-only change log: the newest row of each key that isn't a deletion. A maximum, combined before the shuffle."""
    newest = log.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*log.columns), version).alias("_r"))
    return newest.select("_r.*").where(~F.col(deleted))


def device_search(books: DataFrame, query: str) -> DataFrame:
    """Books whose title, file or authors contain the query without regard to case and accents; devices without a hit drop out."""
    text = F.collate(F.concat_ws(" ", "title", "file_name", "authors"), "UNICODE_CI_AI")
    return books.where(text.contains(F.collate(F.lit(query.strip()), "UNICODE_CI_AI")))


def search_text() -> Column:
    return search_key(F.concat_ws(" ", "title", "file_name", "authors"))


def runs_of_three(x: str) -> np.ndarray:
    """Distinct runs of three characters in order, as numbers of 21 bits a character."""
    c = np.frombuffer(x.encode("utf-32-le"), "<u4").astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) > 2 else c[:0]


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        runs = [runs_of_three(x) for x in b.column(0).to_pylist()]
        keys = np.concatenate([np.zeros(0, np.int64), *runs])
        order = np.argsort(keys, kind="stable")
        own, at = np.unique(keys, return_inverse=True)
        text = np.stack([own >> 42, own >> 21 & 0x1FFFFF, own & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
        grams = pa.array([text[k : k + 3] for k in range(0, len(text), 3)], pa.string())
        rows = np.repeat(np.arange(b.num_rows), [len(r) for r in runs])[order]
        at = at[order]
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([grams.take(pa.array(at[k : k + 100_000])), b.column(1).take(pa.array(rows[k : k + 100_000]))], names=["gram", "id"])


def search_postings(books: DataFrame, id_col: str) -> DataFrame:
    """(gram, id) for every run of three characters of a book's search text: the index of :func:`indexed_search`, to be written once.

    In order of ``gram`` within each batch of texts, so that a written index's pages tell by their bounds which ones a query has to read.
    """
    texts = books.select(search_text().alias("_text"), F.col(id_col).alias("id"))
    return texts.mapInArrow(_sorted_runs, f"gram string, id {texts.schema['id'].dataType.simpleString()}")


def indexed_search(books: DataFrame, id_col: str, postings: DataFrame, query: str, rarest: int = 4) -> DataFrame:
    """Books whose search text contains the query's, by an index: those that hold the ``rarest`` of its runs of three characters are looked at.

    Only postings of these runs are read. A query of fewer than three characters has none, and every book is looked at; ids are unique.
    """
    key = books.sparkSession.range(1).select(search_key(F.lit(query.strip())).alias("k")).first()["k"]
    grams = sorted({key[i : i + 3] for i in range(len(key) - 2)})
    if grams:
        own = postings.where(F.col("gram").isin(grams))
        counts = {r["gram"]: r["n"] for r in own.groupBy("gram").agg(F.count("*").alias("n")).collect()}  # the query's own runs
        if len(counts) < len(grams):
            return books.where("false")
        few = sorted(grams, key=lambda g: (counts[g], g))[:rarest]
        ids = own.where(F.col("gram").isin(few)).groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(few))
        books = books.join(ids.select(F.col("id").alias(id_col)), id_col, "left_semi")
    return books.where(search_text().contains(F.lit(key)))
