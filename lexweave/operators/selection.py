"""Rows chosen by other rows: known paths, queues, selections, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import search_key


def newest_first(rows: DataFrame, at: str, key: str) -> DataFrame:
    return rows.orderBy(F.desc(at), key)


def by_id(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of an id; a filter that reaches the scan."""
    return rows.where(F.col(key) == F.lit(value))


def canonical_path(c: Column) -> Column:
    """An absolute path without ``.``, ``..`` and empty parts."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), step), "/"))  # a path has few parts


def known_paths(requests: DataFrame, books: DataFrame, roots: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``requests(device_id, path)`` that name a listed book, lie below the device's root and have a book's extension, with ``file``."""
    listed = requests.join(books.select("device_id", "path").distinct(), ["device_id", "path"], "left_semi").join(roots.select("device_id", "root"), "device_id")
    root = canonical_path(F.col("root"))
    whole = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat("root", F.lit("/"), "path"))
    placed = listed.withColumn("file", canonical_path(whole))
    inside = (F.col("file") == root) | F.col("file").startswith(F.concat(root, F.lit("/")))
    return placed.where(inside & F.lower(F.regexp_extract("file", r"\.([^./]+)\z", 1)).isin(*kinds)).drop("root")


def queued_jobs(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    """``queue(job_id, place)`` with the jobs; ids without one drop out."""
    return queue.join(jobs, "job_id")


def selected_books(books: DataFrame, selection: DataFrame) -> DataFrame:
    return books.join(selection.select("device_id", "path").distinct(), ["device_id", "path"], "left_semi")


def toggled(selection: Column, keys: Column) -> Column:
    """Keys that are all selected leave the selection, else all of them join it."""
    every = F.size(F.array_except(keys, selection)) == 0
    return F.when(every & (F.size(keys) > 0), F.array_except(selection, keys)).otherwise(F.array_union(selection, keys))


def toggled_one(selection: Column, key: Column) -> Column:
    return F.when(F.array_contains(selection, key), F.array_remove(selection, key)).otherwise(F.array_append(selection, key))


def free_categories(books: DataFrame, common: DataFrame) -> DataFrame:
    """(id, category): common categories that a book lacks, whatever their case and accents."""
    key = lambda c: search_key(c)
    saved = books.select("id", F.explode("categories").alias("c")).select("id", key(F.col("c")).alias("_k")).distinct()
    names = common.agg(F.collect_set("category").alias("_all"))  # a short list of names that all books are offered
    offered = books.select("id").join(F.broadcast(names)).select("id", F.explode("_all").alias("category")).withColumn("_k", key(F.col("category")))
    return offered.join(saved, ["id", "_k"], "left_anti").select("id", "category")


def distinct_categories(categories: Column) -> Column:
    """Categories that differ by more than case: each stands where it first came, written as it last came."""
    key = lambda x: F.lower(x)
    firsts = F.array_distinct(F.transform(categories, key))
    return F.transform(firsts, lambda k: F.element_at(F.filter(categories, lambda x: key(x) == k), -1))


def around(rows: DataFrame, group: str, order: str, active: str, before: int = 4, after: int = 4) -> DataFrame:
    """The rows of each group near its active one (the first if none is), by ``order``."""
    w = Window.partitionBy(group).orderBy(order)
    placed = rows.withColumn("_n", F.row_number().over(w))
    at = placed.withColumn("_at", F.coalesce(F.min(F.when(F.col(active), F.col("_n"))).over(Window.partitionBy(group)), F.lit(1)))
    return at.where((F.col("_n") >= F.col("_at") - before) & (F.col("_n") <= F.col("_at") + after)).drop("_n", "_at")


def longest(candidates: Column) -> Column:
    """The longest of some texts, of equals the first; empty if there is none."""
    return F.aggregate(candidates, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def roots_once(*lists: DataFrame) -> DataFrame:
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out.distinct()


def device_counts(devices: DataFrame, books: DataFrame) -> DataFrame:
    """One row: devices, and books on them."""
    return devices.agg(F.count("*").alias("n_devices")).join(books.agg(F.count("*").alias("n_books")))  # two single rows


def store_problem(paths: DataFrame, stores: dict[str, bool]) -> DataFrame:
    """``paths(path)`` of a manifest with ``problem``: outside the stores, or in one that it declares absent."""
    store = F.get(F.split("path", "/"), F.lit(0))
    declared = F.create_map(*[F.lit(x) for pair in stores.items() for x in pair])
    there = F.try_element_at(declared, store)
    return paths.withColumn("problem", F.when(there.isNull(), "unknown store").when(~there, "undeclared store"))


