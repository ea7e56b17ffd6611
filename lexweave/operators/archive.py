"""Archives: manifests against their entries, and limits on what may be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import is_safe_archive_path


def verify_manifest(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, problem) over both sides: missing, undeclared, size or hash; null where all is well."""
    m = manifest.select("path", F.col("size").alias("_ms"), F.col("sha256").alias("_mh"))
    e = entries.select("path", F.col("size").alias("_es"), F.col("sha256").alias("_eh"))
    both = m.join(e, "path", "full_outer")
    problem = F.when(F.col("_es").isNull(), "missing").when(F.col("_ms").isNull(), "undeclared").when(F.col("_ms") != F.col("_es"), "size").when(F.col("_mh") != F.col("_eh"), "hash")
    return both.select("path", problem.alias("problem"))


def check_entries(entries: DataFrame, *, max_entries: int = 10_000, max_entry: int = 64 << 20, max_total: int = 512 << 20, max_ratio: int = 1000) -> DataFrame:
    """``entries(archive, path, size, compressed)`` per archive: the first rule broken, or null."""
    key = F.lower(F.col("path"))
    out = entries.groupBy("archive").agg(
        F.count("*").alias("n"),
        F.max("size").alias("largest"),
        F.sum("size").alias("total"),
        F.max(F.col("size") / F.greatest(F.col("compressed"), F.lit(1))).alias("ratio"),
        F.count_if(~is_safe_archive_path(F.col("path"))).alias("unsafe"),
        F.count_distinct(key).alias("names"),
    )
    problem = (
        F.when(F.col("n") > max_entries, "entries")
        .when(F.col("unsafe") > 0, "path")
        .when(F.col("names") < F.col("n"), "duplicate")
        .when(F.col("largest") > max_entry, "entry size")
        .when(F.col("total") > max_total, "total size")
        .when(F.col("ratio") > max_ratio, "ratio")
    )
    return out.select("archive", F.col("n").alias("n_entries"), F.col("total").alias("total_size"), problem.alias("problem"))


def job_folders(folders: DataFrame, records: DataFrame, files: DataFrame) -> DataFrame:
    """(job_id, problem): every folder has a record, every record a folder, the original, and its result if done."""
    f = folders.select("job_id").distinct().withColumn("_f", F.lit(1))
    both = records.select("job_id", "status", "original", "result").withColumn("_r", F.lit(1)).join(f, "job_id", "full_outer")
    have = files.select("path").distinct()
    both = both.join(have.select(F.col("path").alias("original"), F.lit(1).alias("_o")), "original", "left").join(have.select(F.col("path").alias("result"), F.lit(1).alias("_d")), "result", "left")
    problem = F.when(F.col("_r").isNull(), "no record").when(F.col("_f").isNull(), "no folder").when(F.col("_o").isNull(), "no original").when((F.col("status") == "done") & F.col("_d").isNull(), "no result")
    return both.select("job_id", problem.alias("problem"))


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """``wanted(folder, base, ext, pos)`` with ``name``: of equal names the later ones get `` (n)``; names in ``taken(folder, name)`` are passed over.

    The k-th wish gets the k-th free number: k and as many as are taken up to there. A taken number u, the i-th of its name, has
    u - i free ones below it, so it counts for all wishes from the (u - i)-th on: wishes and taken numbers stand in one
    order, and a running sum is all it needs.
    """
    key = ["folder", "base", "ext"]
    pattern = r"\A(.*?)(?: \(([1-9]\d{0,17})\))?(\.[^.]*)?\z"
    used = taken.select("folder", F.regexp_extract("name", pattern, 1).alias("base"), F.regexp_extract("name", pattern, 3).alias("ext"), F.coalesce(F.nullif(F.regexp_extract("name", pattern, 2), F.lit("")), F.lit("0")).cast("long").alias("n"))
    w = Window.partitionBy(*key)
    used = used.distinct().withColumn("_at", F.col("n") - F.row_number().over(w.orderBy("n")) + 1)
    rows = wanted.withColumn("_at", (F.row_number().over(w.orderBy("pos")) - 1).cast("long")).withColumn("_used", F.lit(0))
    rows = rows.unionByName(used.select(*key, "_at", F.lit(1).alias("_used")), allowMissingColumns=True)
    n = F.col("_at") + F.sum("_used").over(w.orderBy("_at", F.desc("_used")).rowsBetween(Window.unboundedPreceding, 0))
    named = rows.withColumn("_n", n).where("_used = 0")
    return named.select(*wanted.columns, F.concat("base", F.when(F.col("_n") > 0, F.concat(F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise(""), "ext").alias("name"))
