"""Jobs: order of the list, positions in the queue, records, and time spent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.order import composed_states, numbered
from lexweave.operators.records import JOB_STATES, KINDS

LAST = 9007199254740991


def list_priority(kind: Column, status: Column) -> Column:
    """Translations come first: 0 processing, 1 pausing, 2 paused or pending; then the other kinds: 3, 4, 5; finished jobs 6."""
    step = F.when(status == "processing", 0).when(status == "pausing", 1).when(status.isin("paused", "pending"), 2)
    return F.coalesce(step + F.when(kind == KINDS[0], 0).otherwise(3), F.lit(6))


def list_order(jobs: DataFrame) -> DataFrame:
    """``jobs(job_id, kind, status, queue_order, created_at)`` with ``position``, from 1: within a priority paused and pending
    jobs by their place in the queue (those without one last), others newest first."""
    queued = F.col("status").isin("paused", "pending")
    order = [F.when(queued, F.coalesce("queue_order", F.lit(LAST))), F.when(~queued, F.col("created_at")).desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("job_id")]
    out = numbered(jobs, "position", list_priority(F.col("kind"), F.col("status")), *order)
    return out.withColumn("position", F.col("position") + 1)


def reindex_queue(jobs: DataFrame) -> DataFrame:
    """Paused and pending jobs of each kind numbered 0, 1, ... in their order; those without a place come first."""
    queued = jobs.where("status in ('paused', 'pending')")
    return numbered(queued.withColumnRenamed("queue_order", "_q"), "queue_order", F.coalesce("_q", F.lit(0)), F.col("created_at"), F.col("job_id"), within="kind").drop("_q")


def move_in_queue(queue: DataFrame, moves: DataFrame) -> DataFrame:
    """``queue(job_id, kind, queue_order)``, dense per kind, after ``moves(job_id, position)``: at most one job of each kind goes to a
    position (clamped), and those in between close up. Arithmetic on places, no sort."""
    sizes = queue.groupBy("kind").agg((F.count("*") - 1).alias("_last"))
    at = queue.join(moves, "job_id").join(sizes, "kind").select(F.col("kind").alias("_kind"), F.col("queue_order").alias("_from"), F.least(F.greatest(F.col("position"), F.lit(0)), F.col("_last")).alias("_to"))
    joined = queue.join(F.broadcast(at), F.col("kind") == F.col("_kind"), "left")  # one row per kind at most
    q = F.col("queue_order")
    place = F.when(q == F.col("_from"), F.col("_to")).when((q > F.col("_from")) & (q <= F.col("_to")), q - 1).when((q < F.col("_from")) & (q >= F.col("_to")), q + 1).otherwise(q)
    return joined.withColumn("queue_order", place.cast("long")).select(*queue.columns)


def next_queue_order(jobs: DataFrame) -> DataFrame:
    """The place of a new job of each kind: after the paused and pending ones that have a place, else 0."""
    queued = F.when(F.col("status").isin("paused", "pending"), F.col("queue_order"))
    return jobs.groupBy("kind").agg(F.coalesce(F.max(queued) + 1, F.lit(0)).alias("next_order"))


# What a job says after a restart, while it waits, and when it waits for nothing but its file.
RESTARTED, QUEUED, READY = "Pausada tras reiniciar el servidor", "En cola", "Preparado para generar EPUB"


def upgrade_records(records: DataFrame) -> DataFrame:
    """Records as found after a restart: what was running is paused and says so; what isn't finished waits in order of its creation if it
    had no place, and finished jobs have none; no timer runs. Fields that older records lack get their defaults.

    Columns are those of :func:`lexweave.sources.files.job_records`; of those with a default any may be missing.
    """
    interrupted = F.col("status").isin("processing", "pausing")
    waits = F.col("status").isin("pending", "processing", "pausing", "paused")
    created = F.col("created_at").cast("timestamp")
    new = {
        "queue_order": F.when(waits, F.coalesce(F.col("queue_order").cast("double"), F.unix_millis(created).cast("double"))),
        "started_at": F.lit(None).cast(records.schema["started_at"].dataType),
        "status": F.when(interrupted, "paused").otherwise(F.col("status")),
        "kind": F.coalesce("kind", F.lit(KINDS[0])),
    }
    if "progress" in records.columns:
        new["progress"] = F.when(interrupted, F.col("progress").withField("message", F.lit(RESTARTED))).otherwise(F.col("progress"))
    text_list, terms = F.array().cast("array<string>"), F.array().cast("array<struct<source:string,target:string,type:string>>")
    defaults = {"elapsed_ms": F.lit(0), "archived": F.lit(False), "last_progress_at": F.col("created_at"), "completed_chapters": text_list, "glossary": terms, "translation_memory": F.create_map().cast("map<string,string>")}
    new |= {c: F.coalesce(c, d) for c, d in defaults.items() if c in records.columns}
    return records.withColumns(new)


def public_view(jobs: DataFrame) -> DataFrame:
    """What a client sees: no paths or memory, and a download address only when done."""
    url = F.when(F.col("status") == "done", F.concat(F.lit("/api/jobs/"), F.col("job_id").cast("string"), F.lit("/download")))
    return jobs.select("job_id", "kind", "status", "created_at", url.alias("download_url"))


def active_time(events: DataFrame, key: str, at: str, status: str) -> DataFrame:
    """Milliseconds in ``processing``: from each such event to the key's next event; an open one doesn't count."""
    w = Window.partitionBy(key).orderBy(at, status)
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    spent = F.when(F.col(status) == "processing", us(F.lead(at).over(w)) - us(F.col(at)))
    return events.withColumn("_us", spent).groupBy(key).agg(F.floor(F.coalesce(F.sum("_us"), F.lit(0)) / 1000).alias("active_ms"), F.count("*").alias("n_events"))


#: Status after an event. Events are the calls that change a job: a queue starts it; a request pauses, which takes effect at the
#: next safe point; it ends well or not; a paused or failed job may be resumed. A waiting job is paused at once.
TRANSITIONS = {
    ("pending", "start"): "processing",
    ("pending", "pause"): "paused",
    ("processing", "pause"): "pausing",
    ("pausing", "stopped"): "paused",
    **{(running, end): to for running in ("processing", "pausing") for end, to in (("finish", "done"), ("fail", "error"))},
    **{(ended, "resume"): "pending" for ended in ("paused", "error")},
}


def replay(events: Column) -> Column:
    """Status after an ordered array of event names, from pending; events that don't fit are passed over."""
    table = F.create_map(*[x for (s, e), to in TRANSITIONS.items() for x in (F.lit(f"{s}:{e}"), F.lit(to))])
    return F.aggregate(events, F.lit("pending"), lambda s, e: F.coalesce(F.try_element_at(table, F.concat_ws(":", s, e)), s))


def replay_events(events: DataFrame, key: str, order: list[str], event: str, parts: int | None = None) -> DataFrame:
    """``events`` with ``status``, the key's status after each, from pending; parts of one key are read side by side."""
    at = {s: i for i, s in enumerate(JOB_STATES)}
    names = sorted({e for _, e in TRANSITIONS})
    steps = [tuple(at[TRANSITIONS.get((s, e), s)] for s in JOB_STATES) for e in names]
    symbol = F.nullif(F.array_position(F.array(*[F.lit(e) for e in names]), F.col(event)), F.lit(0)) - 1
    out = composed_states(events.withColumn("_symbol", symbol.cast("int")), key, order, "_symbol", steps, parts)
    return out.select(*events.columns, F.get(F.array(*[F.lit(s) for s in JOB_STATES]), F.col("_is")).alias("status"))


def pause_active(jobs: DataFrame) -> DataFrame:
    """What runs is asked to stop, what waits is paused at once."""
    return jobs.withColumn("status", F.when(F.col("status") == "processing", "pausing").when(F.col("status") == "pending", "paused").otherwise(F.col("status")))


def archive_completed(jobs: DataFrame) -> DataFrame:
    """Finished jobs go to the archive; others, and those that are there, stay as they are."""
    return jobs.withColumn("archived", F.coalesce("archived", F.lit(False)) | (F.col("status") == "done"))


def set_archived(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """``jobs`` after ``changes(job_id, archived)``, with ``outcome``: changed, not-ready (only finished jobs can be) or null."""
    joined = jobs.join(changes.select("job_id", F.col("archived").alias("_to")), "job_id", "left")
    ready = F.col("status") == "done"
    outcome = F.when(F.col("_to").isNotNull(), F.when(ready, "changed").otherwise("not-ready"))
    return joined.withColumn("outcome", outcome).withColumn("archived", F.when(F.col("outcome") == "changed", F.col("_to")).otherwise(F.col("archived"))).drop("_to")


def delete_completed(jobs: DataFrame) -> DataFrame:
    """What is left when finished jobs are deleted."""
    return jobs.where(~F.coalesce(F.col("status") == "done", F.lit(False)))


def start_order(jobs: DataFrame) -> DataFrame:
    """Waiting jobs of each kind that may start, with ``place`` (0: next), in the queue's order. A paused job blocks all behind it, and a
    running one (or one that is stopping) its whole kind: each kind has one worker."""
    busy = jobs.where("status in ('processing', 'pausing')").select(F.col("kind").alias("_k")).distinct()
    queue = reindex_queue(jobs)
    block = queue.where("status = 'paused'").groupBy(F.col("kind").alias("_p")).agg(F.min("queue_order").alias("_at"))
    open_ = queue.join(F.broadcast(busy), F.col("kind") == F.col("_k"), "left_anti").join(F.broadcast(block), F.col("kind") == F.col("_p"), "left")  # a row for each kind
    return open_.where("status = 'pending' and (_at is null or queue_order < _at)").withColumn("place", F.col("queue_order")).select(*jobs.columns, "place")


def queue_message(jobs: DataFrame) -> DataFrame:
    """``jobs(kind, status, total, checkpoint)`` with ``message``: what a waiting job says; null for others."""
    ready = (F.col("kind") == KINDS[0]) & (F.col("total") > 0) & (F.col("checkpoint") >= F.col("total"))
    return jobs.withColumn("message", F.when(F.col("status") == "pending", F.when(ready, READY).otherwise(QUEUED)))
