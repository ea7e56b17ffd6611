"""Revisions of finished outputs: an append-only table, read as of a moment, and restored from with a snapshot first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ``revisions(job_id, revision_id, created_at, file_name, content)`` only grows.
REVISION_ID = r"\A[0-9]{13}-[0-9a-f-]{36}\z"  # fixed value: a moment in milliseconds and a random identifier


def listing(revisions: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, revision_id, created_at, file_name) of jobs' revisions with a sound id, named as their outputs are now; unfinished jobs too."""
    named = jobs.select("job_id", F.col("output_file").alias("_name"))
    rows = revisions.where(F.col("revision_id").rlike(REVISION_ID)).join(named, "job_id")
    return rows.select("job_id", "revision_id", "created_at", F.coalesce("_name", F.concat("revision_id", F.lit(".epub"))).alias("file_name"))


def as_of(revisions: DataFrame, moments: DataFrame) -> DataFrame:
    """For ``moments(job_id, at)`` the newest revision that was there: (job_id, at, revision_id, created_at, content), nulls where there was none.

    A maximum for each moment, combined before the shuffle; no sort of a job's revisions.
    """
    row = F.struct("created_at", "revision_id", "content")
    met = moments.select("job_id", "at").distinct().join(revisions, "job_id", "left")
    best = met.groupBy("job_id", "at").agg(F.max(F.when(F.col("created_at") <= F.col("at"), row)).alias("_r"))
    return best.select("job_id", "at", "_r.revision_id", "_r.created_at", "_r.content")


def restore(jobs: DataFrame, revisions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, added) after ``requests(job_id, revision_id, at, new_id)``, one for each job at most.

    ``jobs(job_id, status, output_file, content)`` gets ``outcome``: restored, or refused where the job isn't finished, has no output, or the revision
    isn't there; null without a request. What a restored job held before is among the ``added`` revisions, named ``new_id``: to be written
    before the jobs are. Both come from one join of what was there, so running it again on the same tables gives the same rows.
    """
    wanted = requests.select("job_id", F.col("revision_id").alias("_wanted"), F.col("at").alias("_at"), F.col("new_id").alias("_new"))
    held = revisions.where(F.col("revision_id").rlike(REVISION_ID)).select("job_id", F.col("revision_id").alias("_wanted"), F.col("content").alias("_content"), F.lit(True).alias("_there"))
    met = jobs.join(wanted, "job_id", "left").join(held, ["job_id", "_wanted"], "left")
    ready = F.coalesce((F.col("status") == "done") & F.col("output_file").isNotNull() & F.col("_there"), F.lit(False))
    outcome = F.when(F.col("_wanted").isNotNull(), F.when(ready, "restored").otherwise("refused"))
    met = met.withColumn("outcome", outcome)
    done = F.coalesce(F.col("outcome") == "restored", F.lit(False))
    added = met.where(done).select("job_id", F.col("_new").alias("revision_id"), F.col("_at").alias("created_at"), F.col("output_file").alias("file_name"), "content")
    after = met.withColumn("content", F.when(done, F.col("_content")).otherwise(F.col("content")))
    return after.select(*jobs.columns, "outcome"), added
