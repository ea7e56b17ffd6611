"""A keyed store in buckets: upserts rewrite the buckets they touch, and no other file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import folder_exists, materialize, release

BUCKET = "_bucket"


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _write(rows: DataFrame, path: str) -> None:
    # a task for each bucket; dynamic, so that only buckets among the rows are replaced
    rows.repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def upsert(changes: DataFrame, path: str, *, key: str = "id", version: str = "version", deleted: str = "is_deleted", buckets: int = 64) -> int:
    """Bring ``changes`` into the store at ``path``; the number of buckets that were written.

    Of the rows of a key the one of the greatest ``version`` stays, among equal ones that of the store; a deletion stays as a row, so changes that come again, or late,
    find it. Rows of touched buckets only are read, merged, written aside and then put in place. A null key is a key.
    """
    spark = changes.sparkSession
    new = materialize(_bucketed(changes, key, buckets))
    touched = sorted(r[BUCKET] for r in new.select(BUCKET).distinct().collect())  # at most ``buckets``
    if not touched:
        return 0
    rows = new.withColumn("_stored", F.lit(0))
    if folder_exists(spark, path):
        held = spark.read.schema(new.schema).parquet(path).where(F.col(BUCKET).isin(touched))
        rows = held.withColumn("_stored", F.lit(1)).unionByName(rows)
    newest = rows.groupBy(F.col(BUCKET).alias("_b"), F.col(key).alias("_k")).agg(F.max_by(F.struct(*new.columns), F.struct(F.col(version), F.col("_stored"))).alias("_r")).select("_r.*")
    merged = materialize(newest)
    _write(merged, path)
    release(new, merged)
    return len(touched)


def read_store(spark: SparkSession, path: str, schema, deleted: str = "is_deleted") -> DataFrame:
    """The rows that aren't deletions."""
    return spark.read.schema(schema).parquet(path).where(~F.col(deleted)).drop(BUCKET)
