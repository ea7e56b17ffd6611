"""Tables of the driver, and where a session keeps its intermediate ones."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a finished write go at once; the written table stands for them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What a Python worker is handed at once.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_OWN: dict[str, str] = {}
_WRITTEN: WeakKeyDictionary = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN.setdefault("dir", tempfile.mkdtemp(prefix="lexweave-"))
    return f"{base.rstrip('/')}/lexweave"


def _folder(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system and path object."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def folder_exists(spark: SparkSession, path: str) -> bool:
    fs, where = _folder(spark, path)
    return fs.exists(where)


def forget_later(spark: SparkSession, path: str) -> tuple:
    """Let an existing folder go with the session."""
    fs, where = _folder(spark, path)
    fs.deleteOnExit(where)
    return fs, where


def materialize(df: DataFrame, batch: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The folder goes with the session, or earlier by :func:`release`. With ``batch``, Python workers get at most so many bytes (or one row) at
    once meanwhile, not Spark's 64 MB, of which functions over long texts hold several copies.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    new = {CLEANUP: "true"} | ({BATCH: batch} if batch else {})
    before = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = forget_later(spark, path)
    return out


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        if t in _WRITTEN:
            fs, where = _WRITTEN.pop(t)
            fs.delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
