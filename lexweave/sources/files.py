"""Tables from folders: books on a device, job records with their faults apart, catalogue payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.replies import publication_year
from lexweave.functions.text import blank_to_null, file_title
from lexweave.operators import records
from lexweave.operators.catalog import CANDIDATE, PLACEHOLDER, interleave
from lexweave.session import materialize

#: Folders that hold no books, and kinds of book files.
SKIPPED_FOLDERS = (".cache", "system", "fonts", "voice", "audible", "screenshots")
BOOK_KINDS = ("epub", "pdf", "azw3", "mobi", "azw", "kfx")
PAYLOAD = "items array<struct<volumeInfo:struct<title:string,authors:array<string>,publishedDate:string,categories:array<string>,industryIdentifiers:array<struct<type:string,identifier:string>>,imageLinks:struct<thumbnail:string,smallThumbnail:string>>>>"


def device_books(spark: SparkSession, root: str, *, depth: int = 10, limit: int = 1000) -> DataFrame:
    """Books below ``root``: (path, title, authors, kind, size, modified), by title in Spanish order. Contents aren't read.

    The limit is one device's; its list is sorted whole.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    inner = F.regexp_replace("path", r"\A.*?" + root.strip("/").replace(".", r"\.") + "/", "")
    files = files.withColumn("inner", inner).where(~F.col("inner").rlike(r"(?i)\.sdr/")).where(F.size(F.split("inner", "/")) <= depth + 1)
    name = F.element_at(F.split("inner", "/"), -1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)\z", 1))
    about = file_title(name)
    skipped = F.exists(F.slice(F.split(F.lower("inner"), "/"), F.lit(1), F.size(F.split("inner", "/")) - 1), lambda x: x.isin(*SKIPPED_FOLDERS))
    out = files.where(kind.isin(*BOOK_KINDS) & ~skipped).select("path", about["title"].alias("title"), about["authors"].alias("authors"), kind.alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out.orderBy(F.collate("title", "es"), "path").limit(limit)


def job_rows(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, faults) of ``bodies(..., body)`` of stored jobs: typed rows of those in their domain, oldest first; the others with ``problem``.

    Bodies are judged once and written, as a sort over them would judge each again for its sample.
    """
    checked = materialize(records.judged_jobs(bodies).drop("body"))
    j = checked.where("problem is null")
    moment = lambda name: F.try_to_timestamp(F.col(f"_j.{name}"))
    text = {"job_id": "id", "kind": "kind", "status": "status", "progress": "progress", "input_file": "inputFileName", "output_file": "outputFileName", "input_path": "inputFilePath", "output_path": "outputFilePath", "error": "error", "glossary": "glossary", "completed_chapters": "completedChapters", "translation_memory": "translationMemory", "queue_order": "queueOrder", "elapsed_ms": "elapsedMs", "archived": "archived"}
    rows = j.select(*[c for c in bodies.columns if c != "body"], *[F.col(f"_j.{n}").alias(c) for c, n in text.items()], F.col("_j.checkpointBatchIndex").alias("checkpoint"), moment("lastProgressAt").alias("last_progress_at"), moment("createdAt").alias("created_at"), moment("startedAt").alias("started_at"), moment("completedAt").alias("completed_at"))
    return rows.orderBy("created_at", "job_id"), checked.where("problem is not null").drop("_j")


def job_records(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, faults) of ``root/<id>/job.json``: what can't be read or breaks the domain is a fault with its path; files stay as they are."""
    raw = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "job.json").option("recursiveFileLookup", "true").load(root)
    return job_rows(raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")))


def import_once(incoming: DataFrame, existing: DataFrame, key: str, is_valid) -> DataFrame:
    """Rows of ``incoming`` to write: all of them if ``existing`` is empty, all are valid and no key repeats; else none."""
    checked = incoming.agg(F.count_if(~is_valid).alias("bad"), (F.count("*") - F.count_distinct(key)).alias("repeats")).crossJoin(existing.agg(F.count("*").alias("n")))
    return incoming.join(F.broadcast(checked.where("bad = 0 and repeats = 0 and n = 0")), how="left_semi")  # one row


DOCS = "docs array<struct<key:string,title:string,author_name:array<string>,first_publish_year:int,isbn:array<string>,cover_i:long,subject:array<string>>>"
NAMES = [c.split()[0] for c in CANDIDATE.split(", ")]


def _listed(c: Column) -> Column:
    """The strings of a list that aren't blank, trimmed."""
    return F.coalesce(F.filter(F.transform(c, blank_to_null), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def volumes(payloads: DataFrame, limit: int = 12, categories: int = 8) -> DataFrame:
    """``payloads(query_id, body)`` of a catalogue of volumes, as candidates; ISBN-13 before ISBN-10, the larger cover first, https."""
    v = payloads.select("query_id", F.posexplode(F.filter(F.from_json("body", PAYLOAD)["items"], lambda x: x.isNotNull())).alias("pos", "i")).where(F.col("pos") < limit).select("query_id", "pos", "i.volumeInfo.*")
    number = lambda kind: F.get(F.filter("industryIdentifiers", lambda x: x["type"] == kind), F.lit(0))["identifier"]
    cover = F.regexp_replace(blank_to_null(F.coalesce("imageLinks.thumbnail", "imageLinks.smallThumbnail")), r"\Ahttp:", "https:")
    made = {"open_library_key": F.lit(None).cast("string"), "title": F.coalesce(blank_to_null(F.col("title")), F.lit(PLACEHOLDER)), "authors": _listed(F.col("authors")), "isbn": blank_to_null(F.coalesce(number("ISBN_13"), number("ISBN_10")))}
    return v.withColumns(made | {"cover_url": cover, "first_publish_year": publication_year(F.col("publishedDate")), "categories": F.slice(_listed(F.col("categories")), 1, categories)}).select(*NAMES)


def library_docs(payloads: DataFrame, cover_url: str, limit: int = 12, categories: int = 8) -> DataFrame:
    """``payloads(query_id, body)`` of a library's search, as candidates: the first ISBN, and a cover by its number in ``cover_url`` (with ``%d``)."""
    v = payloads.select("query_id", F.posexplode(F.filter(F.from_json("body", DOCS)["docs"], lambda x: x.isNotNull())).alias("pos", "d")).where(F.col("pos") < limit).select("query_id", "pos", "d.*")
    made = {
        "open_library_key": blank_to_null(F.col("key")),
        "title": F.coalesce(blank_to_null(F.col("title")), F.lit(PLACEHOLDER)),
        "authors": _listed(F.col("author_name")),
        "isbn": F.get(_listed(F.col("isbn")), F.lit(0)),
        "cover_url": F.when(F.col("cover_i").isNotNull(), F.format_string(cover_url, "cover_i")),
        "categories": F.slice(_listed(F.col("subject")), 1, categories),
    }
    return v.withColumns(made).select(*NAMES)


def either(first: DataFrame, second: DataFrame, failed: DataFrame) -> DataFrame:
    """Candidates of both sources interleaved, where ``failed(query_id, source)`` names the sources that gave none; a query of which both
    failed gives a row with ``error`` alone."""
    lost = failed.groupBy("query_id").agg(F.count_distinct("source").alias("n")).where("n > 1").select("query_id", F.lit("no catalogue answered").alias("error"))
    return interleave(first, second).join(lost, "query_id", "left_anti").withColumn("error", F.lit(None).cast("string")).unionByName(lost, allowMissingColumns=True)


def revisions(spark: SparkSession, root: str) -> DataFrame:
    """Revisions ``<timestamp>-<id>.epub`` below ``root``, newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    out = files.withColumn("name", name).where(F.col("name").rlike(r"\A\d{13}-[a-z0-9]+\.epub\z"))
    return out.select("path", F.timestamp_millis(F.left("name", F.lit(13)).cast("long")).alias("created_at"), "length").orderBy(F.desc("created_at"))


def pages_to_extract(pages: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ready, pending): pages with a usable cached text, and the others."""
    good = cache.where("text is not null").dropDuplicates(["fingerprint", "page"])
    return pages.join(good, ["fingerprint", "page"]), pages.join(good, ["fingerprint", "page"], "left_anti")
