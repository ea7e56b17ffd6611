"""Queries of single rules (names, anchors, boxes, durations) and small checks, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import display, markup
from lexweave.functions import text as T
from lexweave.operators import archive, catalog, links, preview, selection
from lexweave.queries.text import LINES_SQL, _docs, _lines
from lexweave.session import table

CONFIG = '{"pages":3}'


def section_slugs(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", "line_no", T.section_slug(F.when(F.col("line_no") % 7 == 3, "¿¡!?").otherwise(F.col("text")), F.col("line_no")).alias("slug"))


def clean_answers(spark: SparkSession, d: str) -> DataFrame:
    """Lines as a model writes them back: with marks before them, and blanks within."""
    k = F.col("line_no") % 5
    said = F.when(k == 0, F.concat(F.lit(" [ES]  "), "text")).when(k == 1, F.concat(F.lit("Traducción : "), "text")).when(k == 2, F.concat(F.lit("translation: TRADUCCIÓN:"), "text")).when(k == 3, F.concat("text", F.lit(" \n\t"), "text")).otherwise(F.concat("text", F.lit("\t  [es]")))
    return _lines(spark, d).select("doc_id", "line_no", T.clean_translation(said).alias("text"))


def file_titles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.lit("The_"), "c_name", F.when(k % 3 > 0, F.concat(F.lit(" --  A. "), k.cast("string"))).otherwise(""), F.when(k % 3 > 1, " -- more").otherwise(""), F.when(k % 2 == 0, "_ABCDEFGHIJ12").otherwise(""), F.lit(".epub"))
    about = T.file_title(name)
    return table(spark, d, "customer").select("c_custkey", about["title"].alias("title"), F.get(about["authors"], F.lit(0)).alias("author"))


def output_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("in/"), F.when(F.col("p_partkey") % 4 == 0, F.repeat("p_name", F.lit(12))).otherwise(F.col("p_name")), F.lit(" é.pdf"))
    return table(spark, d, "part").select("p_partkey", T.output_file_name(name).alias("name"))


def durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.duration_text(F.col("event_id") * 7919 % 9_000_000).alias("took"))


def pixel_boxes(spark: SparkSession, d: str) -> DataFrame:
    q = lambda c, n: (F.col(c) % n) / F.lit(n)
    box = T.pixel_box(q("l_orderkey", 64) - 0.125, q("l_partkey", 32), q("l_suppkey", 16), q("l_linenumber", 8), 600, 800)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", box.alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("b.left").alias("from_left"), F.col("b.top").alias("from_top"), "b.width", "b.height")


def ring_neighbours(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", display.neighbour(k % 5, F.when(k % 2 == 0, -1).otherwise(1), k % 6).alias("place"))


def local_anchors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    name = F.when(k % 5 == 0, F.concat(F.lit("page-"), k.cast("string"))).when(k % 5 == 1, F.concat(F.lit("p7-n_"), k.cast("string"))).when(k % 5 == 2, "").when(k % 5 == 3, F.concat(F.lit("n "), k.cast("string"), F.lit("é"))).otherwise(F.concat(F.lit("p-"), k.cast("string")))
    return table(spark, d, "pages").select("page_id", markup.local_anchor(k % 9, name).alias("anchor"))


def asset_check(spark: SparkSession, d: str) -> DataFrame:
    """Orders' line items as references to images, of which some aren't there, and as anchors, of which some repeat."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("images/"), (F.col("l_partkey") % 40).cast("string"), F.lit(".png")).alias("path"), (F.col("l_suppkey") % 3).cast("string").alias("anchor"))
    gone = links.missing_assets(li.select("doc_id", "path"), li.where("path not like '%7.png'")).select("doc_id", "path", F.lit(None).cast("long").alias("n"))
    return gone.unionByName(links.duplicate_anchors(li).select("doc_id", F.concat(F.lit("#"), "anchor").alias("path"), "n"))


def job_folder_check(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("job_id"), F.when(k % 2 == 0, "done").otherwise("paused").alias("status"), F.concat(F.lit("in/"), k.cast("string")).alias("original"), F.concat(F.lit("out/"), k.cast("string")).alias("result"))
    files = rows.where("job_id % 5 <> 0").select(F.col("original").alias("path")).unionByName(rows.where("job_id % 4 <> 0").select(F.col("result").alias("path")))
    return archive.job_folders(rows.where("job_id % 7 <> 0").select("job_id"), rows.where("job_id % 11 <> 0"), files)


def free_file_names(spark: SparkSession, d: str) -> DataFrame:
    """Customers as files that want the name of their segment, in folders by nation, where one name of each segment is taken."""
    c = table(spark, d, "customer")
    wanted = c.select(F.col("c_nationkey").alias("folder"), F.col("c_mktsegment").alias("base"), F.lit(".epub").alias("ext"), F.col("c_custkey").alias("pos"))
    taken = c.where("c_nationkey % 2 = 0").select(F.col("c_nationkey").alias("folder"), F.concat("c_mktsegment", F.lit(" (2).epub")).alias("name")).distinct()
    return archive.free_names(wanted, taken)


def user_glossaries(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 500).alias("doc_id"), F.when(F.col("l_orderkey") % 211 == 0, " ").otherwise(F.concat(F.lit("s"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))).alias("source"), F.when(F.col("l_partkey") % 301 == 7, F.repeat(F.lit("x"), F.lit(301))).otherwise("t").alias("target"))
    return catalog.user_glossary_is_valid(li, limit=150)


def roots(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return selection.roots_once(c.select(F.concat(F.lit("/m/"), F.col("c_nationkey").cast("string")).alias("root")), s.select(F.concat(F.lit("/m/"), (F.col("s_nationkey") * 2).cast("string")).alias("root")))


def sample_pairs(spark: SparkSession, d: str) -> DataFrame:
    items = _lines(spark, d).select("doc_id", F.col("line_no").alias("pos"), "text")
    answered = items.where("pos % 3 <> 1").select("doc_id", "pos", F.concat(F.lit("> "), "text").alias("translated"))
    return preview.sample_results(items, answered).select("doc_id", "pos", F.length("text").alias("n"), F.md5("translated").alias("answer"))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.sha256_with_config(F.col("text"), CONFIG).alias("fingerprint"))


QUERIES = {f.__name__: f for f in (section_slugs, clean_answers, file_titles, output_names, durations, pixel_boxes, ring_neighbours, local_anchors, asset_check, job_folder_check, free_file_names, user_glossaries, roots, sample_pairs, fingerprints)}

_TIDY = "trim(regexp_replace(text, '[ \\t]+', ' ', 'g'))"
ORACLE_SQL = {
    "section_slugs": f"WITH {LINES_SQL} SELECT doc_id, line_no, coalesce(nullif(CASE WHEN line_no % 7 = 3 THEN '' ELSE regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END, ''), 'section-' || line_no) AS slug FROM lines",
    "clean_answers": f"WITH {LINES_SQL} SELECT doc_id, line_no, CASE WHEN line_no % 5 < 3 THEN {_TIDY} WHEN line_no % 5 = 3 THEN {_TIDY} || chr(10) || {_TIDY} ELSE {_TIDY} || ' [es]' END AS text FROM lines",
    "file_titles": "SELECT c_custkey, 'The ' || replace(c_name, '_', ' ') AS title, CASE WHEN c_custkey % 3 > 0 THEN 'A. ' || c_custkey END AS author FROM customer",
    "output_names": """WITH n AS (SELECT p_partkey, regexp_replace(repeat(p_name, CASE WHEN p_partkey % 4 = 0 THEN 12 ELSE 1 END) || ' é', '[^a-zA-Z0-9._-]', '-', 'g') AS b FROM part)
SELECT p_partkey, 'translated-' || CASE WHEN length(b) > 184 THEN left(b, 171) || '-' || left(sha256(b || '.pdf'), 12) ELSE b END || '.epub' AS name FROM n""",
    "durations": """WITH s AS (SELECT event_id, CAST(floor(event_id * 7919 % 9000000 / 1000) AS BIGINT) AS s FROM events)
SELECT event_id, CASE WHEN s >= 3600 THEN s // 3600 || ' h ' || s % 3600 // 60 || ' min' WHEN s >= 60 THEN s // 60 || ' min ' || s % 60 || ' s' ELSE s || ' s' END AS took FROM s""",
    "pixel_boxes": """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(CAST(floor(greatest((l_orderkey % 64) / 64.0 - 0.125, 0) * 600) AS INT), 599) AS from_left, least(CAST(floor((l_partkey % 32) / 32.0 * 800) AS INT), 799) AS from_top FROM lineitem)
SELECT *, CAST(greatest(1, least(ceil((l_suppkey % 16) / 16.0 * 600), 600 - from_left)) AS INT) AS width, CAST(greatest(1, least(ceil((l_linenumber % 8) / 8.0 * 800), 800 - from_top)) AS INT) AS height FROM b""",
    "ring_neighbours": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 > 0 THEN (o_orderkey % 5 + CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END + o_orderkey % 6) % (o_orderkey % 6) END AS place FROM orders",
    "local_anchors": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'page-' || page_id WHEN 1 THEN 'p7-n_' || page_id WHEN 2 THEN 'p' || page_id % 9 || '-anchor' WHEN 3 THEN 'p' || page_id % 9 || '-n-' || page_id || '-' ELSE 'p' || page_id % 9 || '-p-' || page_id END AS anchor FROM pages",
    "asset_check": """WITH l AS (SELECT l_orderkey AS doc_id, l_partkey % 40 AS p, l_suppkey % 3 AS a FROM lineitem)
SELECT DISTINCT doc_id, 'images/' || p || '.png' AS path, CAST(NULL AS BIGINT) AS n FROM l WHERE p % 10 = 7 UNION ALL SELECT doc_id, '#' || a, count(*) FROM l GROUP BY doc_id, a HAVING count(*) > 1""",
    "job_folder_check": """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 11 = 0 THEN 'no record' WHEN o_orderkey % 7 = 0 THEN 'no folder' WHEN o_orderkey % 5 = 0 THEN 'no original' WHEN o_orderkey % 4 = 0 THEN 'no result' END AS problem FROM orders WHERE o_orderkey % 77 <> 0""",
    "free_file_names": """WITH w AS (SELECT c_nationkey AS folder, c_mktsegment AS base, '.epub' AS ext, c_custkey AS pos, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS k FROM customer),
n AS (SELECT *, CASE WHEN folder % 2 = 0 AND k >= 2 THEN k + 1 ELSE k END AS n FROM w) SELECT folder, base, ext, pos, base || CASE WHEN n > 0 THEN ' (' || n || ')' ELSE '' END || ext AS name FROM n""",
    "user_glossaries": """WITH l AS (SELECT l_suppkey % 500 AS doc_id, l_orderkey % 211 = 0 OR l_partkey % 301 = 7 AS bad, CASE WHEN l_orderkey % 211 = 0 THEN ' ' ELSE 's' || l_orderkey || '-' || l_linenumber END AS s FROM lineitem)
SELECT doc_id, count(*) <= 150 AND NOT bool_or(bad) AND count(*) = count(DISTINCT s) AS is_valid FROM l GROUP BY 1""",
    "roots": "SELECT '/m/' || c_nationkey AS root FROM customer UNION SELECT '/m/' || s_nationkey * 2 FROM supplier",
    "sample_pairs": f"WITH {LINES_SQL} SELECT doc_id, line_no AS pos, length(text) AS n, md5(CASE WHEN line_no % 3 <> 1 THEN '> ' || text ELSE '' END) AS answer FROM lines",
    "fingerprints": f"SELECT doc_id, sha256(text || '{CONFIG}') AS fingerprint FROM documents",
}
