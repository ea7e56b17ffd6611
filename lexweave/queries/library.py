"""Queries over the reading log, catalogues, jobs, budgets and archives, with their SQL.

Orders stand in for books and jobs, events for usage and job events.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import archive, budget, catalog, jobs, layout, readinglog
from lexweave.session import forget_later, shared_dir, table
from lexweave.sources.files import job_rows
from lexweave.sources.store import read_store, upsert
from lexweave.streaming.stateful import admit_stream, job_states


def _books(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "read").when(F.col("o_orderstatus") == "O", "reading").otherwise("to-read")
    done = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 11 != 0), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select(F.col("o_orderkey").alias("id"), "o_custkey", status.alias("status"), done.alias("finished_at"), F.array("o_orderpriority").alias("categories"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"))


BOOKS_SQL = """books AS (SELECT o_orderkey AS id, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'read' WHEN 'O' THEN 'reading' ELSE 'to-read' END AS status,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS finished_at, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS started_at FROM orders)"""


def reading_months(spark: SparkSession, d: str) -> DataFrame:
    return readinglog.months(_books(spark, d))


def year_list(spark: SparkSession, d: str) -> DataFrame:
    return readinglog.years(_books(spark, d))


def monthly_activity(spark: SparkSession, d: str) -> DataFrame:
    return readinglog.monthly_activity(spark, _books(spark, d), "1996")


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return readinglog.status_counts(_books(spark, d))


def reading_filter(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("title"), F.array("c_mktsegment").alias("authors"))
    return readinglog.filter_books(_books(spark, d).join(c, "o_custkey"), "read", "1996", " Build").select("id", "title", "finished_at")


def status_change(spark: SparkSession, d: str) -> DataFrame:
    b = _books(spark, d).select("id", "status", F.when(F.col("id") % 2 == 0, F.col("started_at")).alias("started_at"), "finished_at")
    patch = b.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "read").otherwise("reading").alias("status"), F.lit(None).cast("string").alias("finished_at"), (F.col("id") % 5 == 0).alias("has_finished"))
    return readinglog.change_status(b, patch, "2026-01-01")


def latest_rows(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("version"), F.col("l_quantity").alias("value"), (F.col("l_linenumber") == 4).alias("is_deleted"))
    li = li.groupBy("id", "version").agg(F.max("value").alias("value"), F.bool_or("is_deleted").alias("is_deleted"))
    return readinglog.latest_rows(li)


def bucket_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Line items as versions of an order, brought into a store in three steps, the last one late and in part a repeat."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("version"), F.col("l_quantity").alias("value"), (F.col("l_linenumber") == 4).alias("is_deleted"))
    li = li.groupBy("id", "version").agg(F.max("value").alias("value"), F.bool_or("is_deleted").alias("is_deleted"))
    at = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    for part in (li.where("version in (1, 3)"), li.where("version > 3"), li.where("version in (2, 4)")):
        upsert(part, at, buckets=16)
    forget_later(spark, at)
    return read_store(spark, at, li.schema)


def reading_dates(spark: SparkSession, d: str) -> DataFrame:
    from lexweave.functions.text import is_reading_date

    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    day = F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lpad((k % 33).cast("string"), 2, "0"))
    hour = F.lpad((k % 26).cast("string"), 2, "0")
    time = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit("T"), hour, F.lit(":30:00Z"))).when(k % 5 == 2, F.concat(F.lit("T"), hour, F.lit(":30Z"))).when(k % 5 == 3, F.concat(F.lit("T"), hour, F.lit(":00:00"))).otherwise(F.concat(F.lit("T"), hour, F.lit(":00:00.5+02:00")))
    return o.select("o_orderkey", is_reading_date(F.concat(day, time)).alias("is_valid"))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("pending", "processing", "pausing", "paused", "done", "error"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        (F.col("o_custkey") % 100).alias("bucket"),
        F.when(F.col("o_custkey") % 2 == 0, "epub-translation").otherwise("pdf-conversion").alias("kind"),
        status.alias("status"),
        F.nullif(F.col("o_orderkey") % 7, F.lit(0)).alias("queue_order"),
        F.col("o_orderdate").alias("created_at"),
    )


JOBS_SQL = """jobs AS (SELECT o_orderkey AS job_id, o_custkey % 100 AS bucket, CASE WHEN o_custkey % 2 = 0 THEN 'epub-translation' ELSE 'pdf-conversion' END AS kind,
  (['pending', 'processing', 'pausing', 'paused', 'done', 'error'])[CAST(o_orderkey % 6 + 1 AS INT)] AS status, nullif(o_orderkey % 7, 0) AS queue_order, o_orderdate AS created_at FROM orders)"""


def job_listing(spark: SparkSession, d: str) -> DataFrame:
    return jobs.list_order(_jobs(spark, d)).select("job_id", "kind", "status", "position")


def queue_reindex(spark: SparkSession, d: str) -> DataFrame:
    return jobs.reindex_queue(_jobs(spark, d)).select("job_id", "kind", "queue_order")


def queue_move(spark: SparkSession, d: str) -> DataFrame:
    q = jobs.reindex_queue(_jobs(spark, d)).select("job_id", "kind", "queue_order")
    return jobs.move_in_queue(q, q.groupBy("kind").agg(F.max("job_id").alias("job_id")).select("job_id", F.lit(3).alias("position")))


def next_queue_order(spark: SparkSession, d: str) -> DataFrame:
    return jobs.next_queue_order(_jobs(spark, d))


def record_upgrade(spark: SparkSession, d: str) -> DataFrame:
    r = _jobs(spark, d).withColumn("started_at", F.lit("2026-01-01"))
    return jobs.upgrade_records(r).select("job_id", "status", "queue_order", "started_at")


def with_nulls(body: Column, *names: str) -> Column:
    """An object's JSON with null fields before its own."""
    return F.concat(F.lit("{" + "".join(f'"{n}":null,' for n in names)), F.substring(body, 2, 1 << 30))


def stored_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Stored records, some of them old or broken, read, brought up to date after a restart, and listed."""
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("pending", "processing", "pausing", "paused", "done", "error"))), (k % 6 + 1).cast("int"))
    moment = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    job = F.struct(
        k.cast("string").alias("id"),
        F.when(k % 13 == 0, "translation").when(k % 3 == 0, "epub-translation").when(k % 3 == 1, "pdf-conversion").alias("kind"),
        status.alias("status"),
        F.struct((k % 4).alias("current"), F.lit(3).alias("total"), F.lit("m").alias("message")).alias("progress"),
        (k % 5).alias("checkpointBatchIndex"),
        F.lit("i.epub").alias("inputFileName"),
        F.lit("p").alias("inputFilePath"),
        F.when(k % 17 != 0, "q").alias("outputFilePath"),
        moment.alias("createdAt"),
        F.when(k % 2 == 0, moment).alias("startedAt"),
        F.when(k % 7 != 0, k % 7).alias("queueOrder"),
    )
    bodies = table(spark, d, "orders").select(F.when(k % 19 == 0, "{").otherwise(with_nulls(F.to_json(job), "outputFileName", "error")).alias("body"))
    sound, _ = job_rows(bodies)
    restarted = jobs.upgrade_records(sound.select("job_id", "kind", "status", "progress", "checkpoint", "glossary", "queue_order", "archived", "created_at", "started_at"))
    told = jobs.queue_message(jobs.list_order(restarted).withColumn("total", F.col("progress.total")))
    return told.select("job_id", "kind", "status", F.coalesce("message", "progress.message").alias("message"), "queue_order", F.col("started_at").cast("string").alias("started_at"), "archived", F.size("glossary").alias("n_terms"), "position")


def bulk_updates(spark: SparkSession, d: str) -> DataFrame:
    """Jobs after waiting and running ones are paused, finished ones archived, and some taken out of the archive again."""
    k = F.col("job_id")
    j = _jobs(spark, d).withColumn("archived", F.when(k % 5 == 0, True))
    changes = j.where("job_id % 4 = 0").select("job_id", F.lit(False).alias("archived"))
    return jobs.set_archived(jobs.archive_completed(jobs.pause_active(j)), changes).select("job_id", "status", "archived", "outcome")


def start_order(spark: SparkSession, d: str) -> DataFrame:
    """Each bucket of customers as a queue of its own: what may start behind paused and running jobs."""
    j = _jobs(spark, d).withColumn("kind", F.concat("kind", F.lit("-"), F.col("bucket").cast("string"))).where("job_id % 64 < 16 and status not in ('processing', 'pausing') or job_id % 1024 < 4")
    return jobs.start_order(j).select("job_id", "kind", "place")


def left_after_delete(spark: SparkSession, d: str) -> DataFrame:
    return jobs.delete_completed(_jobs(spark, d)).groupBy("kind", "status").agg(F.count("*").alias("n_jobs"))


def public_projection(spark: SparkSession, d: str) -> DataFrame:
    return jobs.public_view(_jobs(spark, d)).drop("created_at")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def active_time(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "ts", F.when(F.col("event_id") % 3 == 0, "processing").otherwise("paused").alias("status"))
    return jobs.active_time(e, "user_id", "ts", "status")


STEPS = ("start", "pause", "stopped", "resume", "finish", "fail")


def job_replay(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, STEPS)), ((F.col("event_id") * 7 + F.col("user_id")) % 6 + 1).cast("int"))
    e = _events(spark, d).select("user_id", "ts", "event_id", name.alias("e"))
    done = jobs.replay_events(e, "user_id", ["ts", "event_id"], "e")
    return done.groupBy("user_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))


def _usage(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", "user_id", "event_type", F.lit(1).alias("requests"), budget.input_bound(F.col("props")).alias("input_bound"), F.floor("value").alias("output_tokens"))


USAGE_SQL = "usage AS (SELECT event_id, user_id, event_type, 1 AS requests, strlen(props) + 256 AS input_bound, CAST(floor(value) AS BIGINT) AS output_tokens FROM events)"
SUMS_SQL = "CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(input_bound) AS BIGINT) AS input_bound, CAST(sum(output_tokens) AS BIGINT) AS output_tokens"


def budget_ledger(spark: SparkSession, d: str) -> DataFrame:
    return budget.ledger(_usage(spark, d), "user_id", "event_type")


def ledger_merge(spark: SparkSession, d: str) -> DataFrame:
    u = _usage(spark, d)
    a, b = budget.ledger(u.where("event_id % 2 = 0"), "user_id"), budget.ledger(u.where("event_id % 2 = 1"), "user_id")
    return budget.merge_ledgers(a, b, "user_id", ("requests", "input_bound", "output_tokens"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(*_request())


def _request() -> list:
    n = F.col("event_id")
    kind = F.when(n % 3 == 0, "sample").otherwise("job").alias("kind")
    return ["user_id", "event_id", kind, F.concat(F.lit("k"), (n % 4).cast("string")).alias("id"), F.lit(1).cast("long").alias("requests"), budget.input_bound(F.col("props")).cast("long").alias("input_bound"), F.floor("value").cast("long").alias("output_tokens")]


#: Caps that the given events reach in every scope and counter.
CAPS = {
    "deployment": {"requests": 40, "input_bound": 9_000, "output_tokens": 9_000},
    "job": {"requests": 9, "input_bound": 2_100, "output_tokens": 1_500},
    "samples": {"requests": 9, "input_bound": 2_400, "output_tokens": 900},
    "sample": {"requests": 3, "input_bound": 1_000, "output_tokens": 300},
}


def budget_admission(spark: SparkSession, d: str) -> DataFrame:
    return budget.admit(_requests(spark, d), "user_id", ["event_id"], CAPS).select("user_id", "event_id", "refused_by")


def _cap_sql(counter: str) -> str:
    return "CASE split_part(k, ':', 1) " + " ".join(f"WHEN '{scope}' THEN {caps[counter]}" for scope, caps in CAPS.items()) + " END"


def _used_sql(field: str) -> str:
    return f"coalesce(list_filter(used, lambda u: u.k = k)[1].{field}, 0) + {field}0"


ADMISSION_SQL = f"""WITH RECURSIVE r AS (SELECT user_id, event_id, CAST(1 AS BIGINT) AS q0, CAST(strlen(props) + 256 AS BIGINT) AS i0, CAST(floor(value) AS BIGINT) AS o0, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
  CASE WHEN event_id % 3 = 0 THEN ['deployment', 'samples', 'sample:k' || event_id % 4] ELSE ['deployment', 'job:k' || event_id % 4] END AS ks FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS refused, CAST([] AS STRUCT(k VARCHAR, q BIGINT, i BIGINT, o BIGINT)[]) AS used FROM r
  UNION ALL SELECT user_id, n, event_id, over, CASE WHEN over IS NULL THEN list_concat(list_filter(used, lambda u: NOT list_contains(ks, u.k)), list_transform(ks, lambda k: {{'k': k, 'q': {_used_sql("q")}, 'i': {_used_sql("i")}, 'o': {_used_sql("o")}}})) ELSE used END FROM (
    SELECT f.user_id, r.n, r.event_id, f.used, r.ks, q0, i0, o0, list_filter(r.ks, lambda k: {_used_sql("q")} > {_cap_sql("requests")} OR {_used_sql("i")} > {_cap_sql("input_bound")} OR {_used_sql("o")} > {_cap_sql("output_tokens")})[1] AS over FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1))
SELECT user_id, event_id, CASE split_part(refused, ':', 1) WHEN 'samples' THEN 'sample' ELSE split_part(refused, ':', 1) END AS refused_by FROM f WHERE n > 0"""


def _stream(spark: SparkSession, d: str, make) -> DataFrame:
    """Run a stream over the events file to its end and read what it wrote."""
    schema = table(spark, d, "events").schema
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = make(source)
    writer = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    forget_later(spark, at)
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def stream_budget(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d, lambda s: admit_stream(s.select(*_request()), "user_id", "event_id", CAPS)).select("user_id", "event_id", "refused_by")


def stream_job_states(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, STEPS)), ((F.col("event_id") * 7 + F.col("user_id")) % 6 + 1).cast("int")).alias("e")
    return _stream(spark, d, lambda s: job_states(s.select("user_id", "event_id", name), "user_id", "event_id", "e"))


def manifest_verify(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    entry = lambda df, text: df.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length(text).alias("size"), F.sha2(text, 256).alias("sha256"))
    changed = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("x"), "text")).when(F.col("doc_id") % 10 == 4, F.concat(F.lit("#"), F.expr("substring(text, 2)"))).otherwise(F.col("text"))
    found = entry(docs.where("doc_id % 10 <> 1"), changed).unionByName(entry(docs.where("doc_id % 10 = 1").withColumn("doc_id", -F.col("doc_id")), F.col("text")))
    return archive.verify_manifest(entry(docs, F.col("text")), found)


def archive_limits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 1000).alias("archive"),
        F.concat(F.when(F.col("l_orderkey") % 97 == 0, "../").otherwise("a/"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("path"),
        F.floor(F.col("l_extendedprice") * 100).alias("size"),
        (F.col("l_quantity") * 100).cast("long").alias("compressed"),
    )
    return archive.check_entries(e, max_entries=90, max_entry=9_000_000, max_total=300_000_000, max_ratio=2000)


def locale_sort(spark: SparkSession, d: str) -> DataFrame:
    from lexweave.functions.text import strip_accents
    from lexweave.operators.order import numbered

    p = table(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("title"))
    ranked = numbered(p, "rank", F.collate("title", "es"), F.col("doc_id"), within="lang")
    return ranked.select("doc_id", "lang", F.xxhash64(strip_accents(F.col("title"))).alias("plain"), "rank")


def contiguous_prefix(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").where("not (l_orderkey % 3 = 0 and l_linenumber = 2)").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"))
    return layout.contiguous_prefix(done, "doc_id")


def json_shred(spark: SparkSession, d: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n_events"), F.count(k).alias("n_k"), F.sum(k).alias("sum_k"))


def _catalogue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    rows = p.select(
        F.floor(F.col("p_partkey") / 12).alias("query_id"),
        (F.col("p_partkey") % 12).cast("int").alias("pos"),
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("/works/"), F.col("p_partkey").cast("string"))).alias("open_library_key"),
        F.when(F.col("p_partkey") % 17 == 0, " ").otherwise(F.initcap("p_name")).alias("title"),
        F.array("p_brand").alias("authors"),
        F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("978-0-00-"), F.lpad(F.floor(F.col("p_partkey") / 2).cast("string"), 7, "0"))).alias("isbn"),
        F.concat(F.lit("http://covers/"), F.col("p_partkey").cast("string")).alias("cover_url"),
        (F.col("p_size") + 1950).cast("int").alias("first_publish_year"),
        F.array("p_type", "p_brand").alias("categories"),
    )
    second = rows.withColumns({"title": F.upper("title"), "open_library_key": F.lit(None).cast("string"), "isbn": F.when(F.col("pos") % 2 == 0, F.col("isbn")), "cover_url": F.lit(None).cast("string"), "categories": F.array(F.lit("x"), F.element_at("categories", 1))})
    return rows, second


def catalog_merge(spark: SparkSession, d: str) -> DataFrame:
    a, b = _catalogue(spark, d)
    merged = catalog.merge_candidates(catalog.interleave(catalog.clean_candidates(a), catalog.clean_candidates(b)))
    return merged.withColumns({k: F.array_join(k, " | ") for k in ("authors", "categories")})


def catalog_interleave(spark: SparkSession, d: str) -> DataFrame:
    a, b = _catalogue(spark, d)
    return catalog.interleave(catalog.clean_candidates(a), catalog.clean_candidates(b)).select("query_id", "pos", "title", "isbn", "cover_url")


def page_batches(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")).distinct()
    return layout.page_batches(pages, pages.where("(doc_id + page) % 3 = 0"))


QUERIES = {f.__name__: f for f in (reading_months, year_list, monthly_activity, status_counts, reading_filter, status_change, latest_rows, bucket_upsert, reading_dates, job_listing, queue_reindex, queue_move, next_queue_order, record_upgrade, stored_jobs, bulk_updates, start_order, left_after_delete, public_projection, active_time, job_replay, budget_ledger, ledger_merge, budget_admission, stream_budget, stream_job_states, manifest_verify, archive_limits, locale_sort, contiguous_prefix, json_shred, catalog_merge, catalog_interleave, page_batches)}

REINDEX_SQL = "SELECT job_id, kind, row_number() OVER (PARTITION BY kind ORDER BY coalesce(queue_order, 0), created_at, job_id) - 1 AS queue_order FROM jobs WHERE status IN ('paused', 'pending')"

ORACLE_SQL = {
    "reading_months": f"WITH {BOOKS_SQL} SELECT coalesce(left(finished_at, 7), 'undated') AS month, count(*) AS n_books FROM books GROUP BY 1",
    "year_list": f"WITH {BOOKS_SQL} SELECT DISTINCT left(finished_at, 4) AS year FROM books WHERE finished_at IS NOT NULL",
    "monthly_activity": f"WITH {BOOKS_SQL} SELECT CAST(m AS INT) AS month, (SELECT count(*) FROM books WHERE status = 'read' AND finished_at LIKE '1996-' || lpad(CAST(m AS VARCHAR), 2, '0') || '%') AS n_books FROM range(1, 13) t(m)",
    "status_counts": f"WITH {BOOKS_SQL} SELECT count(*) AS n_all, count(*) FILTER (WHERE status = 'read') AS n_read, count(*) FILTER (WHERE status = 'reading') AS n_reading, count(*) FILTER (WHERE status = 'to-read') AS n_to_read, count(*) FILTER (WHERE status = 'abandoned') AS n_abandoned FROM books",
    "reading_filter": f"WITH {BOOKS_SQL} SELECT id, c_name AS title, finished_at FROM books JOIN customer ON c_custkey = o_custkey WHERE status = 'read' AND finished_at LIKE '1996%' AND contains(lower(c_name || ' ' || c_mktsegment || ' ' || o_orderpriority), 'build')",
    "status_change": f"""WITH {BOOKS_SQL}, b AS (SELECT id, status, CASE WHEN id % 2 = 0 THEN started_at END AS started_at, finished_at FROM books)
SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'read' ELSE 'reading' END ELSE status END AS status, CASE WHEN id % 3 = 0 AND id % 2 = 1 AND started_at IS NULL THEN '2026-01-01' ELSE started_at END AS started_at,
CASE WHEN id % 3 = 0 AND id % 5 = 0 THEN NULL WHEN id % 3 = 0 AND id % 2 = 0 AND finished_at IS NULL THEN '2026-01-01' ELSE finished_at END AS finished_at FROM b""",
    "latest_rows": "WITH l AS (SELECT l_orderkey AS id, l_linenumber AS version, max(l_quantity) AS value, l_linenumber = 4 AS is_deleted FROM lineitem GROUP BY 1, 2, 4), x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS n FROM l) SELECT id, version, value, is_deleted FROM x WHERE n = 1 AND NOT is_deleted",
    "bucket_upsert": "WITH l AS (SELECT l_orderkey AS id, l_linenumber AS version, max(l_quantity) AS value, l_linenumber = 4 AS is_deleted FROM lineitem GROUP BY 1, 2, 4), x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS n FROM l) SELECT id, version, value, is_deleted FROM x WHERE n = 1 AND NOT is_deleted",
    "reading_dates": "SELECT o_orderkey, try_cast(strftime(o_orderdate, '%Y-%m-') || lpad(CAST(o_orderkey % 33 AS VARCHAR), 2, '0') AS DATE) IS NOT NULL AND CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN o_orderkey % 26 < 24 WHEN 4 THEN o_orderkey % 26 < 24 ELSE false END AS is_valid FROM orders",
    "job_listing": f"""WITH {JOBS_SQL}, p AS (SELECT *, status IN ('paused', 'pending') AS queued, CASE status WHEN 'processing' THEN 0 WHEN 'pausing' THEN 1 WHEN 'paused' THEN 2 WHEN 'pending' THEN 2 END + CASE WHEN kind = 'epub-translation' THEN 0 ELSE 3 END AS pr FROM jobs)
SELECT job_id, kind, status, row_number() OVER (ORDER BY coalesce(pr, 6), CASE WHEN queued THEN coalesce(queue_order, 9007199254740991) END NULLS FIRST, created_at DESC, job_id) AS position FROM p""",
    "queue_reindex": f"WITH {JOBS_SQL} {REINDEX_SQL}",
    "queue_move": f"""WITH {JOBS_SQL}, q AS ({REINDEX_SQL}), c AS (SELECT kind, max(job_id) AS job_id, arg_max(queue_order, job_id) AS old, least(3, count(*) - 1) AS new FROM q GROUP BY kind)
SELECT q.job_id, q.kind, CASE WHEN q.job_id = c.job_id THEN c.new WHEN q.queue_order > c.old AND q.queue_order <= c.new THEN q.queue_order - 1 WHEN q.queue_order < c.old AND q.queue_order >= c.new THEN q.queue_order + 1 ELSE q.queue_order END AS queue_order FROM q JOIN c USING (kind)""",
    "next_queue_order": f"WITH {JOBS_SQL} SELECT kind, coalesce(max(queue_order) FILTER (WHERE status IN ('paused', 'pending')) + 1, 0) AS next_order FROM jobs GROUP BY 1",
    "record_upgrade": f"""WITH {JOBS_SQL} SELECT job_id, CASE WHEN status IN ('processing', 'pausing') THEN 'paused' ELSE status END AS status, CAST(CASE WHEN status NOT IN ('done', 'error') THEN coalesce(queue_order, epoch_ms(created_at)) END AS DOUBLE) AS queue_order, CAST(NULL AS VARCHAR) AS started_at FROM jobs""",
    "stored_jobs": """WITH j AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 1 THEN 'pdf-conversion' ELSE 'epub-translation' END AS kind, (['pending', 'processing', 'pausing', 'paused', 'done', 'error'])[CAST(o_orderkey % 6 + 1 AS INT)] AS old, o_orderkey % 4 AS current, o_orderkey % 5 AS cp, nullif(o_orderkey % 7, 0) AS q, o_orderdate AS c FROM orders
  WHERE o_orderkey % 19 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0),
u AS (SELECT *, CASE WHEN old IN ('processing', 'pausing') THEN 'paused' ELSE old END AS status, CAST(CASE WHEN old NOT IN ('done', 'error') THEN coalesce(q, epoch_ms(c)) END AS DOUBLE) AS queue_order FROM j),
p AS (SELECT *, CASE WHEN status IN ('pending', 'paused') THEN CASE kind WHEN 'epub-translation' THEN 2 ELSE 5 END ELSE 6 END AS pr FROM u)
SELECT CAST(k AS VARCHAR) AS job_id, kind, status, CASE WHEN status = 'pending' THEN CASE WHEN kind = 'epub-translation' AND cp >= 3 THEN 'Preparado para generar EPUB' ELSE 'En cola' END WHEN old IN ('processing', 'pausing') THEN 'Pausada tras reiniciar el servidor' ELSE 'm' END AS message,
  queue_order, CAST(NULL AS VARCHAR) AS started_at, false AS archived, 0 AS n_terms, row_number() OVER (ORDER BY pr, CASE WHEN pr < 6 THEN queue_order END NULLS FIRST, c DESC, CAST(k AS VARCHAR)) AS position FROM p""",
    "bulk_updates": f"""WITH {JOBS_SQL} SELECT job_id, CASE status WHEN 'processing' THEN 'pausing' WHEN 'pending' THEN 'paused' ELSE status END AS status, CASE WHEN status = 'done' THEN job_id % 4 <> 0 ELSE job_id % 5 = 0 END AS archived, CASE WHEN job_id % 4 = 0 THEN CASE WHEN status = 'done' THEN 'changed' ELSE 'not-ready' END END AS outcome FROM jobs""",
    "start_order": f"""WITH {JOBS_SQL}, j AS (SELECT * REPLACE (kind || '-' || bucket AS kind) FROM jobs WHERE job_id % 64 < 16 AND status NOT IN ('processing', 'pausing') OR job_id % 1024 < 4),
q AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY coalesce(queue_order, 0), created_at, job_id) - 1 AS place FROM j WHERE status IN ('paused', 'pending'))
SELECT job_id, kind, place FROM q WHERE status = 'pending' AND NOT EXISTS (FROM q p WHERE p.kind = q.kind AND p.status = 'paused' AND p.place < q.place) AND NOT EXISTS (FROM j b WHERE b.kind = q.kind AND b.status IN ('processing', 'pausing'))""",
    "left_after_delete": f"WITH {JOBS_SQL} SELECT kind, status, count(*) AS n_jobs FROM jobs WHERE status <> 'done' GROUP BY 1, 2",
    "public_projection": f"WITH {JOBS_SQL} SELECT job_id, kind, status, CASE WHEN status = 'done' THEN '/api/jobs/' || job_id || '/download' END AS download_url FROM jobs",
    "active_time": """WITH e AS (SELECT user_id, ts, CASE WHEN event_id % 3 = 0 THEN 'processing' ELSE 'paused' END AS status FROM events), l AS (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, status)) - epoch_us(ts) AS us FROM e)
SELECT user_id, CAST(floor(coalesce(sum(us) FILTER (WHERE status = 'processing'), 0) / 1000) AS BIGINT) AS active_ms, count(*) AS n_events FROM l GROUP BY 1""",
    "job_replay": """WITH RECURSIVE r AS (SELECT user_id, (['start', 'pause', 'stopped', 'resume', 'finish', 'fail'])[CAST((event_id * 7 + user_id) % 6 + 1 AS INT)] AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
t AS (SELECT * FROM (VALUES """ + ", ".join(f"('{s}', '{e}', '{to}')" for (s, e), to in jobs.TRANSITIONS.items()) + """) x(s, e, s2)),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 'pending' AS status FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT f.user_id, f.n + 1, coalesce(t.s2, f.status) FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1 LEFT JOIN t ON t.s = f.status AND t.e = r.e)
SELECT user_id, arg_max(status, n) AS status FROM f GROUP BY 1""",
    "stream_job_states": """WITH RECURSIVE r AS (SELECT user_id, event_id, (['start', 'pause', 'stopped', 'resume', 'finish', 'fail'])[CAST((event_id * 7 + user_id) % 6 + 1 AS INT)] AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
t AS (SELECT * FROM (VALUES """ + ", ".join(f"('{s}', '{e}', '{to}')" for (s, e), to in jobs.TRANSITIONS.items()) + """) x(s, e, s2)),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS event_id, '' AS e, 'pending' AS status FROM r UNION ALL SELECT f.user_id, r.n, r.event_id, r.e, coalesce(t.s2, f.status) FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1 LEFT JOIN t ON t.s = f.status AND t.e = r.e)
SELECT user_id, event_id, e, status FROM f WHERE n > 0""",
    "catalog_merge": """WITH RECURSIVE p AS (SELECT CAST(floor(p_partkey / 12) AS BIGINT) AS query_id, p_partkey % 12 AS pos, p_partkey AS k, p_brand, p_type, CAST(p_size + 1950 AS INT) AS year,
  CASE WHEN p_partkey % 17 <> 0 THEN list_reduce(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), lambda a, b: a || ' ' || b) END AS title,
  CASE WHEN p_partkey % 3 <> 0 THEN '978000' || lpad(CAST(floor(p_partkey / 2) AS BIGINT)::VARCHAR, 7, '0') END AS isbn FROM part),
u AS (SELECT query_id, pos, 0 AS s, CASE WHEN k % 4 = 0 THEN '/works/' || k END AS olk, title, p_brand, isbn, 'https://covers/' || k AS cover, year, [p_type, p_brand] AS cats FROM p
  UNION ALL SELECT query_id, pos, 1, NULL, upper(title), p_brand, CASE WHEN pos % 2 = 0 THEN isbn END, NULL, year, ['x', p_type] FROM p),
c AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos, s) AS n, {'olk': olk, 'title': coalesce(title, 'Sin título'), 'author': p_brand, 'isbn': isbn, 'cover': cover, 'year': year, 'cats': cats, 'sources': 1} AS r FROM u),
f AS (SELECT query_id, n, r, trim(regexp_replace(lower(strip_accents(r.title)), '[^a-z0-9]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(strip_accents(r.author)), '[^a-z0-9]+', ' ', 'g')) AS sig FROM c),
w AS (SELECT query_id, n, [r] AS m, [{'k': r.isbn, 'place': CAST(1 AS BIGINT)}] AS isbns, [{'k': sig, 'place': CAST(1 AS BIGINT)}] AS sigs FROM f WHERE n = 1
  UNION ALL
  SELECT query_id, n, m, list_append(isbns, {'k': m[place].isbn, 'place': place}),
    list_append(sigs, {'k': trim(regexp_replace(lower(strip_accents(m[place].title)), '[^a-z0-9]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(strip_accents(m[place].author)), '[^a-z0-9]+', ' ', 'g')), 'place': place})
  FROM (SELECT query_id, n, isbns, sigs, coalesce(place, len(m) + 1) AS place, CASE WHEN place IS NULL THEN list_append(m, r) ELSE list_concat(list_append(m[1:place - 1], {'olk': coalesce(m[place].olk, r.olk), 'title': CASE WHEN m[place].title = 'Sin título' THEN r.title ELSE m[place].title END,
      'author': m[place].author, 'isbn': coalesce(m[place].isbn, r.isbn), 'cover': coalesce(m[place].cover, r.cover), 'year': coalesce(m[place].year, r.year),
      'cats': list_filter(list_concat(m[place].cats, r.cats), lambda e, i: list_position(list_concat(m[place].cats, r.cats), e) = i)[1:8], 'sources': m[place].sources + 1}), m[place + 1:]) END AS m
    FROM (SELECT w.query_id, f.n, m, r, isbns, sigs, coalesce(list_filter(isbns, lambda e: e.k = r.isbn)[-1].place, list_filter(sigs, lambda e: e.k = sig)[-1].place) AS place FROM w JOIN f ON f.query_id = w.query_id AND f.n = w.n + 1))),
l AS (SELECT query_id, arg_max(m, n) AS m FROM w GROUP BY 1),
o AS (SELECT query_id, unnest(range(1, least(len(m), 18) + 1)) AS i, m FROM l)
SELECT query_id, CAST(i - 1 AS INT) AS pos, m[i].olk AS open_library_key, m[i].title AS title, m[i].author AS authors, m[i].isbn AS isbn, m[i].cover AS cover_url, m[i].year AS first_publish_year, array_to_string(m[i].cats, ' | ') AS categories, m[i].sources AS n_sources FROM o""",
    "catalog_interleave": """WITH p AS (SELECT CAST(floor(p_partkey / 12) AS BIGINT) AS query_id, p_partkey % 12 AS pos, p_partkey AS k, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE list_reduce(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), lambda a, b: a || ' ' || b) END AS title,
  CASE WHEN p_partkey % 3 <> 0 THEN '978000' || lpad(CAST(floor(p_partkey / 2) AS BIGINT)::VARCHAR, 7, '0') END AS isbn FROM part),
u AS (SELECT query_id, pos, 0 AS s, title, isbn, 'https://covers/' || k AS cover_url FROM p UNION ALL SELECT query_id, pos, 1, upper(title), CASE WHEN pos % 2 = 0 THEN isbn END, NULL FROM p)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos, s) - 1 AS INT) AS pos, coalesce(title, 'Sin título') AS title, isbn, cover_url FROM u""",
    "budget_ledger": f"WITH {USAGE_SQL} SELECT user_id, event_type, {SUMS_SQL} FROM usage GROUP BY 1, 2",
    "ledger_merge": f"""WITH {USAGE_SQL}, s AS (SELECT user_id, event_id % 2 AS h, {SUMS_SQL} FROM usage GROUP BY 1, 2) SELECT user_id, max(requests) AS requests, greatest(max(input_bound), 0) AS input_bound, greatest(CAST(max(output_tokens) AS BIGINT), CASE WHEN count(*) < 2 THEN 0 END) AS output_tokens FROM s GROUP BY 1""",
    "budget_admission": ADMISSION_SQL,
    "stream_budget": ADMISSION_SQL,
    "manifest_verify": """SELECT 'd/' || doc_id AS path, CASE doc_id % 10 WHEN 1 THEN 'missing' WHEN 3 THEN 'size' WHEN 4 THEN CASE WHEN strlen('#' || substr(text, 2)) <> strlen(text) THEN 'size' WHEN left(text, 1) <> '#' THEN 'hash' END END AS problem FROM documents
UNION ALL SELECT 'd/-' || doc_id, 'undeclared' FROM documents WHERE doc_id % 10 = 1""",
    "archive_limits": """WITH e AS (SELECT l_orderkey % 1000 AS archive, CASE WHEN l_orderkey % 97 = 0 THEN '../' ELSE 'a/' END || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS path, CAST(floor(l_extendedprice * 100) AS BIGINT) AS size, CAST(l_quantity * 100 AS BIGINT) AS compressed FROM lineitem),
a AS (SELECT archive, count(*) AS n, max(size) AS largest, CAST(sum(size) AS BIGINT) AS total, max(size / greatest(compressed, 1)) AS ratio, count(*) FILTER (WHERE path LIKE '../%') AS unsafe, count(DISTINCT path) AS names FROM e GROUP BY 1)
SELECT archive, n AS n_entries, total AS total_size, CASE WHEN n > 90 THEN 'entries' WHEN unsafe > 0 THEN 'path' WHEN names < n THEN 'duplicate' WHEN largest > 9000000 THEN 'entry size' WHEN total > 300000000 THEN 'total size' WHEN ratio > 2000 THEN 'ratio' END AS problem FROM a""",
    "contiguous_prefix": """WITH d AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS page FROM lineitem WHERE NOT (l_orderkey % 3 = 0 AND l_linenumber = 2)), x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS n FROM d)
SELECT doc_id, count(*) FILTER (WHERE n = page) AS n_contiguous, count(*) AS n_done FROM x GROUP BY 1""",
    "json_shred": "SELECT event_type, count(*) AS n_events, count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS n_k, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY 1",
    "page_batches": "WITH p AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS page FROM lineitem) SELECT doc_id, page, CAST(floor((page - 1) / 3.0) AS INT) AS batch_no FROM p WHERE (doc_id + page) % 3 <> 0",
}
