"""Domains of records that come from outside: what breaks one, and the cleaned form of what doesn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import is_reading_date, trim_all

# Names that are no keys, states of a book, and fields that a change may name.
RESERVED = ("__proto__", "prototype", "constructor")
STATES = ("to-read", "reading", "read", "abandoned")
CHANGES = ("status", "rating", "notes", "finished_at", "categories")
SAFE = 9007199254740991


def is_safe_key(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[a-zA-Z0-9_-]{1,240}\z") & ~c.isin(*RESERVED), F.lit(False))


def _short(c: Column, most: int) -> Column:
    return F.coalesce((F.length(c) <= most) & ~F.contains(c, F.lit("\x00")), F.lit(False))


def _short_list(c: Column) -> Column:
    return F.coalesce((F.size(c) <= 100) & F.forall(c, lambda x: _short(x, 500)), F.lit(False))


def listed(c: Column) -> Column:
    """Trimmed strings of a list, without blanks."""
    return F.filter(F.transform(c, trim_all), lambda x: x != "")


def is_candidate(rows: DataFrame) -> Column:
    """Domain of a book candidate; covers must be https."""
    c = {n: F.col(n) for n in rows.columns}
    year = c["first_publish_year"].isNull() | c["first_publish_year"].between(0, 9999)
    cover = c["cover_url"].isNull() | (_short(c["cover_url"], 4096) & F.coalesce(c["cover_url"].rlike(r"(?i)\Ahttps://[^/\s]"), F.lit(False)))
    texts = (c["open_library_key"].isNull() | _short(c["open_library_key"], 500)) & (c["isbn"].isNull() | _short(c["isbn"], 30))
    return _short(c["title"], 500) & (trim_all(F.coalesce(c["title"], F.lit(""))) != "") & _short_list(c["authors"]) & _short_list(c["categories"]) & texts & year & cover


def parse_candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound, refused): sound ones with title, authors and categories trimmed, categories once each."""
    judged = rows.withColumn("_ok", is_candidate(rows))
    clean = {"title": trim_all(F.col("title")), "authors": listed(F.col("authors")), "categories": F.array_distinct(listed(F.col("categories")))}
    return judged.where("_ok").drop("_ok").withColumns(clean), judged.where("not _ok").drop("_ok")


def is_change(fields: Column, status: Column, rating: Column, notes: Column, finished_at: Column, categories: Column) -> Column:
    """Whether a change names known fields only and each that it names (``fields``) is in its domain."""
    names = lambda n: F.array_contains(fields, F.lit(n))
    return F.coalesce(
        (F.size(F.array_except(fields, F.array(*map(F.lit, CHANGES)))) == 0)
        & (~names("status") | F.coalesce(status.isin(*STATES), F.lit(False)))
        & (~names("rating") | rating.isNull() | ((rating == F.floor(rating)) & rating.between(1, 5)))
        & (~names("notes") | _short(notes, 20_000))
        & (~names("finished_at") | finished_at.isNull() | is_reading_date(finished_at))
        & (~names("categories") | _short_list(categories)),
        F.lit(False),
    )


def normalize_metadata(rows: DataFrame, need_language: bool = True) -> DataFrame:
    """``rows(..., title, authors, language, publisher, description)`` trimmed, blank authors left out; rows without a title (or language)
    or with a missing field go."""
    fields = ("title", "language", "publisher", "description")
    whole = rows.where(" and ".join(f"{c} is not null" for c in (*fields, "authors"))).where(F.forall("authors", lambda x: x.isNotNull()))
    clean = whole.withColumns({c: trim_all(F.col(c)) for c in fields} | {"authors": listed(F.col("authors"))})
    return clean.where((F.col("title") != "") & (F.col("language") != "" if need_language else F.lit(True)))


def is_usage(u: Column) -> Column:
    """Counters of a usage: whole, safe and not negative."""
    return F.coalesce(u["requests"].between(0, SAFE) & u["input_bound"].between(0, SAFE) & u["output_tokens"].between(0, SAFE), F.lit(False))


USAGE = "struct<requests:long,input_bound:long,output_tokens:long>"
LEDGER = f"version int, total {USAGE}, samples {USAGE}, jobs map<string,{USAGE}>, sample_operations map<string,{USAGE}>"


def is_ledger(rows: DataFrame) -> Column:
    """Domain of a stored budget ledger."""
    keyed = lambda m: F.coalesce(F.forall(F.map_keys(m), is_safe_key) & F.forall(F.map_values(m), is_usage), F.lit(False))
    version = F.coalesce(F.col("version") == 1, F.lit(False))
    return version & is_usage(F.col("total")) & is_usage(F.col("samples")) & keyed(F.col("jobs")) & keyed(F.col("sample_operations"))


def read_ledger(bodies: DataFrame) -> DataFrame:
    """Ledgers of ``bodies(body)``; one that is damaged fails the query, so no call is admitted on an unknown count."""
    parsed = bodies.select("body", F.from_json("body", LEDGER).alias("l")).select("body", "l.*")
    sound = F.try_parse_json(F.col("body")).isNotNull() & is_ledger(parsed)
    return parsed.where(F.when(sound, True).otherwise(F.raise_error(F.lit("damaged ledger")).cast("boolean"))).drop("body")


JOB = (
    "id string, kind string, status string, progress struct<current:double,total:double,message:string>, checkpointBatchIndex double, inputFileName string, outputFileName string, "
    "inputFilePath string, outputFilePath string, error string, glossary array<struct<source:string,target:string,type:string>>, completedChapters array<string>, "
    "translationMemory map<string,string>, queueOrder double, elapsedMs double, lastProgressAt string, archived boolean, createdAt string, startedAt string, completedAt string"
)
# Kinds and states of a job.
KINDS = ("epub-translation", "pdf-conversion")
JOB_STATES = ("pending", "processing", "pausing", "paused", "done", "error")


def judged_jobs(bodies: DataFrame) -> DataFrame:
    """``bodies(body)`` of stored jobs with ``problem`` (what can't be read, else the first field outside its domain, else null) and ``_j``, the record.

    Rules and fields read a body that is parsed once: a generated row, as an expression would be parsed again wherever it is named.
    """
    j = F.from_json("body", f"{JOB}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    whole = lambda c: F.coalesce((c >= 0) & (c == F.floor(c)), F.lit(False))
    moment = lambda c: F.try_to_timestamp(c).isNotNull()
    c = {n.split()[0]: F.col(f"_j.{n.split()[0]}") for n in JOB.split(", ")}
    # null is a value of these fields, and absent isn't
    raw = lambda name: F.try_variant_get(F.col("_v"), f"$.{name}", "variant")
    given = lambda name: raw(name).isNotNull()
    is_null = lambda name: F.coalesce(F.is_variant_null(raw(name)), F.lit(False))
    texts = c["inputFileName"].isNotNull() & c["inputFilePath"].isNotNull() & c["outputFilePath"].isNotNull()
    terms = F.forall(F.coalesce(c["glossary"], F.array().cast("array<struct<source:string,target:string,type:string>>")), lambda g: g["source"].isNotNull() & g["target"].isNotNull() & (g["type"].isNull() | g["type"].isin("name", "place", "term", "title")))
    dates = F.forall(F.array_compact(F.array(c["startedAt"], c["completedAt"], c["lastProgressAt"])), moment)
    lists = F.forall(F.coalesce(c["completedChapters"], F.array().cast("array<string>")), lambda x: x.isNotNull()) & F.forall(F.map_values(F.coalesce(c["translationMemory"], F.create_map().cast("map<string,string>"))), lambda x: x.isNotNull())
    wrong = lambda ok, name: F.when(~F.coalesce(ok, F.lit(False)), name)
    problem = F.coalesce(
        F.when(F.col("_j").isNull() | F.col("_j._broken").isNotNull(), "unreadable"),
        wrong(c["id"].rlike(r"\A[a-zA-Z0-9_-]{1,240}\z"), "id"),
        wrong((c["kind"].isNull() | c["kind"].isin(*KINDS)) & ~is_null("kind"), "kind"),
        wrong(c["status"].isin(*JOB_STATES), "status"),
        wrong(whole(c["progress"]["current"]) & whole(c["progress"]["total"]) & c["progress"]["message"].isNotNull() & whole(c["checkpointBatchIndex"]), "progress"),
        wrong(texts & given("outputFileName") & given("error"), "files"),
        wrong(moment(c["createdAt"]) & dates & (c["elapsedMs"].isNull() | (c["elapsedMs"] >= 0)) & ~is_null("elapsedMs"), "times"),
        wrong(terms & lists & ~is_null("glossary") & ~is_null("completedChapters") & ~is_null("translationMemory"), "lists"),
        wrong(~is_null("archived"), "archived"),
    )
    parsed = bodies.select("*", F.inline(F.array(F.struct(j.alias("_j"), F.try_parse_json(F.col("body")).alias("_v")))))
    return parsed.withColumn("problem", problem).drop("_v")


def job_problem(bodies: DataFrame) -> DataFrame:
    """``bodies(body)`` of stored jobs with ``problem``: what can't be read, else the first field outside its domain, else null."""
    return judged_jobs(bodies).drop("_j")


def checkpoint_problem(saved: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """``expected(key, done)`` with ``problem``: a checkpoint may only be missing before the first batch; else its ids (``item_id``) differ
    and none of its texts is blank."""
    s = saved.groupBy(key).agg(F.count("*").alias("_n"), F.count_distinct("item_id").alias("_ids"), F.count_if(F.coalesce(trim_all(F.col("text")), F.lit("")) == "").alias("_blank"))
    problem = F.when(F.col("_n").isNull(), F.when(F.col("done") > 0, "missing")).when(F.col("_ids") < F.col("_n"), "repeated ids").when(F.col("_blank") > 0, "blank texts")
    return expected.join(s, key, "left").select(*expected.columns, problem.alias("problem"))


DEVICES = "array<struct<id:string,name:string,books:array<struct<path:string,fileName:string,title:string,authors:array<string>,size:double,modifiedAt:string,format:string>>>>"


def parse_devices(bodies: DataFrame) -> DataFrame:
    """``bodies(body_id, body)`` with ``devices``, null if any device or book of the list breaks its domain."""
    d = F.from_json("body", DEVICES)
    texts = lambda b: F.forall(F.array(b["path"], b["fileName"], b["title"], b["modifiedAt"], b["format"]), lambda x: F.coalesce(F.length(x) <= 4096, F.lit(False)))
    authors = lambda b: F.coalesce((F.size(b["authors"]) <= 100) & F.forall(b["authors"], lambda x: F.coalesce(F.length(x) <= 500, F.lit(False))), F.lit(False))
    book = lambda b: texts(b) & authors(b) & F.coalesce((b["size"] >= 0) & (b["size"] < float("inf")), F.lit(False))
    sound = lambda x: F.coalesce(x["id"].rlike(r"\A[a-zA-Z0-9_-]{1,240}\z") & (F.length(x["name"]) <= 500) & (F.size(x["books"]) <= 1000) & F.forall(x["books"], book), F.lit(False))
    parsed = bodies.withColumn("devices", d)
    return parsed.withColumn("devices", F.when(F.coalesce((F.size("devices") <= 100) & F.forall("devices", sound), F.lit(False)), F.col("devices")))
