"""Queries over text items, pages and links, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import layout, links, memory, readinglog, segment
from lexweave.session import materialize, table
from lexweave.sources.archives import text_nodes

LIMIT = segment.MAX_TOKENS * 4
TRIM = f"'{T.TRIMMED}'"

SPACE = r"\t\n\v\f\r " + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))

LINES_SQL = f"""lines AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS line_no, t AS text
  FROM (SELECT doc_id, i, trim(l, {TRIM}) AS t FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
  WHERE t <> '')"""

BATCHES_SQL = f"""{LINES_SQL},
sized AS (SELECT doc_id, line_no, text, length(text) AS chars, greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens FROM lines),
b AS (
  SELECT doc_id, line_no, text, chars, tokens, 0 AS batch_no, CAST(chars AS BIGINT) AS c, CAST(tokens AS BIGINT) AS t FROM sized WHERE line_no = 0
  UNION ALL
  SELECT s.doc_id, s.line_no, s.text, s.chars, s.tokens,
    CASE WHEN b.c + s.chars > 2500 OR b.t + s.tokens > 600 THEN b.batch_no + 1 ELSE b.batch_no END,
    CASE WHEN b.c + s.chars > 2500 OR b.t + s.tokens > 600 THEN s.chars ELSE b.c + s.chars END,
    CASE WHEN b.c + s.chars > 2500 OR b.t + s.tokens > 600 THEN s.tokens ELSE b.t + s.tokens END
  FROM b JOIN sized s ON s.doc_id = b.doc_id AND s.line_no = b.line_no + 1)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return segment.text_lines(_docs(spark, d))


def text_batches(spark: SparkSession, d: str) -> DataFrame:
    return segment.batch_summary(segment.greedy_batches(_docs(spark, d)))


def oversize_split(spark: SparkSession, d: str) -> DataFrame:
    long = _lines(spark, d).where(F.length("text") > 1000)
    return segment.hard_split(long, 1000).select("doc_id", "line_no", "part", "text")


def oversize_lossless(spark: SparkSession, d: str) -> DataFrame:
    pieces = segment.split_oversized(_lines(spark, d), 300)
    joined = segment.recombine(pieces, ["doc_id", "line_no"])
    longest = pieces.where("part is not null").groupBy("doc_id", "line_no").agg(F.max(F.length("text")).alias("m"))
    return joined.join(longest, ["doc_id", "line_no"], "left").select("doc_id", "line_no", "text", (F.coalesce("m", F.lit(0)) <= 300).alias("fits"))


def batch_context(spark: SparkSession, d: str) -> DataFrame:
    return segment.batch_context(segment.greedy_batches(_docs(spark, d)))


def translation_memory(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    known = lines.where("doc_id % 2 = 0").select(F.col("text").alias("source_text")).distinct().withColumn("target_text", F.concat(F.lit("[M] "), "source_text"))
    done = memory.apply_memory(lines, known)
    return done.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.count_if("is_fallback").alias("n_fallback"), F.sum(F.length("translated")).alias("chars"))


def missing_texts(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    known = lines.where("doc_id % 2 = 0").select(F.col("text").alias("source_text")).distinct().withColumn("target_text", F.when(F.length("source_text") % 2 == 0, "x").otherwise(""))
    return memory.missing_texts(lines, known)


def translation_winner(spark: SparkSession, d: str) -> DataFrame:
    b = segment.greedy_batches(_docs(spark, d)).withColumn("batch_no", F.col("doc_id") * 100000 + F.col("batch_no"))
    fresh = b.withColumn("translated", F.concat_ws(":", F.lit("[ES]"), F.col("batch_no").cast("string"), F.col("line_no").cast("string"), "text"))
    return memory.winning_translations(fresh)


def recombine_fragments(spark: SparkSession, d: str) -> DataFrame:
    return segment.recombine(segment.hard_split(_lines(spark, d), 200), ["doc_id", "line_no"])


def id_set_validation(spark: SparkSession, d: str) -> DataFrame:
    """Received items with faults by document; the unexpected id is one that no line has, however long the document."""
    lines = _lines(spark, d).select("doc_id", F.col("line_no").alias("item_id"), "text")
    kind = F.col("doc_id") % 5
    got = lines.where(~((kind == 0) & (F.col("item_id") % 7 == 3)))
    got = got.withColumn("text", F.when((kind == 2) & (F.col("item_id") == 0), " ").otherwise(F.col("text")))
    got = got.withColumn("item_id", F.when((kind == 3) & (F.col("item_id") == 1), -1).otherwise(F.col("item_id")))
    got = got.unionByName(lines.where((kind == 1) & (F.col("item_id") == 0)))
    return memory.id_set_report(lines, got, "doc_id")


def checkpoint_prefix(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d).select("doc_id", F.col("line_no").alias("seq"), F.concat_ws("_", F.col("doc_id").cast("string"), F.col("line_no").cast("string")).alias("item_id"))
    saved = lines.where((F.col("seq") < 5) & ~((F.col("doc_id") % 3 == 1) & (F.col("seq") == 1)))
    saved = saved.withColumn("item_id", F.when((F.col("doc_id") % 3 == 2) & (F.col("seq") == 2), "x").otherwise(F.col("item_id")))
    return memory.checkpoint_prefix(lines, saved, "doc_id")


def html_text_nodes(spark: SparkSession, d: str) -> DataFrame:
    return text_nodes(table(spark, d, "pages"), "page_id", "html")


def _headings(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "pages").select("page_id", F.regexp_extract_all("html", F.lit("<h[1-6]>([^<]*)</h[1-6]>"), F.lit(1)).alias("t"), F.regexp_extract_all("html", F.lit("<h([1-6])>[^<]*</h[1-6]>"), F.lit(1)).alias("l"))
    each = found.select("page_id", F.posexplode(F.arrays_zip("t", "l")).alias("pos", "x"))
    return each.select("page_id", "pos", F.col("x.t").alias("title"), F.col("x.l").cast("int").alias("level"))


HEADINGS_SQL = """headings AS (
  SELECT page_id, CAST(i - 1 AS INT) AS pos, t AS title, CAST(l AS INT) AS level FROM (
    SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6]>([^<]*)</h[1-6]>', 1)) AS t, unnest(regexp_extract_all(html, '<h([1-6])>[^<]*</h[1-6]>', 1)) AS l,
      generate_subscripts(regexp_extract_all(html, '<h[1-6]>([^<]*)</h[1-6]>', 1), 1) AS i FROM pages))"""
KEY_SQL = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', '', 'g')"


def html_headings(spark: SparkSession, d: str) -> DataFrame:
    return _headings(spark, d).withColumn("key", T.title_key(F.col("title")))


def heading_parent(spark: SparkSession, d: str) -> DataFrame:
    marks = _lines(spark, d).select("doc_id", F.col("line_no").alias("pos"), (F.length("text") % 4 + 1).alias("level"))
    return layout.heading_parents(marks)


def _turns(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter(F.transform(F.split("text", "[.!?\n]"), T.trim_all), lambda x: x != "")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.posexplode(kept).alias("para_no", "text"))


TURNS_SQL = f"""paras AS (
  SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY i) - 1 AS INT) AS para_no, t AS text FROM (
    SELECT conv_id AS doc_id, CAST(turn AS INT) AS page, i, trim(l, {TRIM}) AS t FROM (
      SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[.!?\\n]')) AS l, generate_subscripts(regexp_split_to_array(text, '[.!?\\n]'), 1) AS i FROM conversations)) WHERE t <> '')"""


def _with_marks(paras: DataFrame) -> DataFrame:
    """A running title twice before and a page number or two after each page of most documents; some pages lack the second title."""
    some = paras.where("doc_id % 4 <> 0").select("doc_id", "page").distinct()
    mark = lambda at, text, keep="true": some.where(keep).select("doc_id", "page", F.lit(at).alias("para_no"), text.alias("text"))
    title, number = F.concat(F.lit("Title "), F.col("doc_id").cast("string")), F.col("page").cast("string")
    marks = [mark(-2, title), mark(-1, title, "page % 3 <> 0"), mark(100000, number), mark(100001, number, "page % 2 = 1"), mark(100002, F.lit("End"), "doc_id % 4 = 2")]
    for m in marks:
        paras = paras.unionByName(m)
    return paras


_MARK_SQL = [(-2, "'Title ' || doc_id", "true"), (-1, "'Title ' || doc_id", "page % 3 <> 0"), (100000, "CAST(page AS VARCHAR)", "true"), (100001, "CAST(page AS VARCHAR)", "page % 2 = 1"), (100002, "'End'", "doc_id % 4 = 2")]
MARKED_SQL = f"""{TURNS_SQL},
titled AS (SELECT DISTINCT doc_id, page FROM paras WHERE doc_id % 4 <> 0),
marked AS (SELECT * FROM paras {" ".join(f"UNION ALL SELECT doc_id, page, {at}, {text} FROM titled WHERE {keep}" for at, text, keep in _MARK_SQL)})"""


def page_headers(spark: SparkSession, d: str) -> DataFrame:
    return layout.strip_headers(_with_marks(_turns(spark, d)))


def page_footers(spark: SparkSession, d: str) -> DataFrame:
    return layout.strip_footers(_with_marks(_turns(spark, d)))


def _edge_sql(depth: int, footer: bool) -> str:
    order = "DESC" if footer else "ASC"
    shared = "(list_unique(ks) = 1 OR list_bool_and(list_transform(ks, lambda k: regexp_full_match(k, '[0-9]+'))))" if footer else "list_unique(ks) = 1"
    number = "OR (regexp_full_match(key, '[0-9]+') AND pages >= 2)" if footer else ""
    return f"""WITH {MARKED_SQL},
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY para_no {order}) - 1 AS ix, trim(text, {TRIM}) AS key FROM marked),
listed AS (SELECT doc_id, page, list(key ORDER BY ix) AS l FROM placed GROUP BY 1, 2),
docs AS (SELECT doc_id, list(l ORDER BY page) AS ls, count(*) AS pages, min(len(l)) AS shortest FROM listed GROUP BY 1),
tried AS (SELECT doc_id, list_transform(ls, lambda l: l[i]) AS ks, ls[1][i] AS first FROM (SELECT *, unnest(range(1, least({depth}, shortest) + 1)) AS i FROM docs WHERE pages >= 2)),
marks AS (SELECT DISTINCT doc_id, first FROM tried WHERE first <> '' AND {shared}),
flagged AS (SELECT p.*, (EXISTS (SELECT 1 FROM marks m WHERE m.doc_id = p.doc_id AND m.first = p.key) {number}) AS gone FROM placed p JOIN docs USING (doc_id))
SELECT doc_id, page, para_no, text FROM (SELECT *, bool_or(NOT gone) OVER (PARTITION BY doc_id, page ORDER BY ix) AS seen FROM flagged) WHERE seen"""


def section_split(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d).select("doc_id", (F.floor(F.col("line_no") / 5) + 1).cast("int").alias("page"), F.col("line_no").alias("pos"), "text")
    k = F.col("pos") % 9
    marks = F.when(k == 3, F.concat(F.lit("Chapter "), F.col("pos").cast("string"))).when(k == 5, "XVIII)").when(k == 6, "IV.").when(k == 7, "THE SEA").when(F.col("pos") % 25 == 8, "Épílogo")
    return layout.split_sections(lines.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.coalesce(marks, "text"))))


def _placed_items(spark: SparkSession, d: str) -> DataFrame:
    """Line items as pieces of text on pages: suppliers are documents, parts are pages."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    y = F.lit(700) - ((k * 37 + n * 11) % 240) * 0.75
    text = F.concat(F.lit(" w"), (k % 1000).cast("string"), F.when(k % 5 == 0, "-").otherwise(" "))
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("doc_id"), (F.col("l_partkey") % 25).cast("int").alias("page"), (k * 8 + n).alias("item_no"), F.when(k % 41 == 0, "  ").otherwise(text).alias("str"), ((k * 13 + n) % 400).cast("double").alias("x"), F.when(k % 53 != 0, y.cast("double")).alias("y"), F.when(k % 7 == 0, -4.0).when(k % 11 == 0, None).otherwise(8.0).alias("height"))


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.assemble_lines(_placed_items(spark, d))


def page_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return layout.assemble_paragraphs(layout.assemble_lines(_placed_items(spark, d)))


_ITEMS_SQL = """it AS (SELECT l_suppkey % 20 AS doc_id, CAST(l_partkey % 25 AS INT) AS page, l_orderkey * 8 + l_linenumber AS item_no, 'w' || l_orderkey % 1000 || CASE WHEN l_orderkey % 5 = 0 THEN '-' ELSE '' END AS t, CAST((l_orderkey * 13 + l_linenumber) % 400 AS DOUBLE) AS x,
  CASE WHEN l_orderkey % 53 = 0 THEN 0 ELSE 700 - ((l_orderkey * 37 + l_linenumber * 11) % 240) * 0.75 END::DOUBLE AS y, CASE WHEN l_orderkey % 7 = 0 THEN 4 WHEN l_orderkey % 11 = 0 THEN 10 ELSE 8 END::DOUBLE AS h FROM lineitem WHERE l_orderkey % 41 <> 0),
so AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY round_even(y / 2, 0) DESC, x, item_no) AS n FROM it),
wa AS (SELECT doc_id, page, n, 0 AS line_no, y AS anchor, t, h FROM so WHERE n = 1
  UNION ALL SELECT so.doc_id, so.page, so.n, CASE WHEN abs(so.y - anchor) <= 2.5 THEN line_no ELSE line_no + 1 END, CASE WHEN abs(so.y - anchor) <= 2.5 THEN anchor ELSE so.y END, so.t, so.h FROM wa JOIN so ON so.doc_id = wa.doc_id AND so.page = wa.page AND so.n = wa.n + 1),
li AS (SELECT doc_id, page, line_no, replace(string_agg(t, ' ' ORDER BY n), '- ', '-') AS text, min(anchor) AS y, max(h) AS height FROM wa GROUP BY 1, 2, 3)"""
PAGE_LINES_SQL = f"WITH RECURSIVE {_ITEMS_SQL} SELECT doc_id, page, line_no, text, y, height FROM li"
PAGE_PARAGRAPHS_SQL = f"""WITH RECURSIVE {_ITEMS_SQL},
st AS (SELECT *, coalesce(lag(y) OVER w - y > greatest(lag(height) OVER w * 1.45, 11), false) AS s FROM li WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)),
nu AS (SELECT *, CAST(sum(CAST(s AS INT)) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS INT) AS para_no FROM st)
SELECT doc_id, page, para_no, replace(string_agg(text, ' ' ORDER BY line_no), '- ', '-') AS text FROM nu GROUP BY 1, 2, 3"""

_CASED = lambda p: p.replace("\\A", "^").replace("\\z", "$")
SECTIONS_SQL = f"""WITH {LINES_SQL},
m AS (SELECT doc_id, CAST(floor(line_no / 5) + 1 AS INT) AS page, line_no AS pos, CASE WHEN doc_id % 3 = 0 THEN text WHEN line_no % 9 = 3 THEN 'Chapter ' || line_no WHEN line_no % 9 = 5 THEN 'XVIII)' WHEN line_no % 9 = 6 THEN 'IV.' WHEN line_no % 9 = 7 THEN 'THE SEA' WHEN line_no % 25 = 8 THEN 'Épílogo' ELSE text END AS text FROM lines),
f AS (SELECT *, length(regexp_replace(text, '[^A-Za-zÁÉÍÓÚÜÑáéíóúüñ]', '', 'g')) >= 4 AND upper(text) = text AND length(text) <= 120 AND NOT regexp_matches(text, '[.!?;:]$') AS u,
  regexp_matches(text, '{_CASED(layout.NUMBERED)}') AS nl,
  length(text) BETWEEN 3 AND 120 AND NOT regexp_matches(text, '[.!?;:]$') AND (regexp_matches(text, '(?i){_CASED(layout.CHAPTER_WORD)}') OR regexp_matches(text, '(?i){_CASED(layout.CHAPTER_NUMBER)}') OR regexp_matches(text, '{_CASED(layout.ROMAN_TITLE)}')) AS ch FROM m),
l AS (SELECT doc_id, list({{'page': page, 'pos': pos, 'text': text, 'u': u, 'nl': nl, 'ch': ch}} ORDER BY pos) AS ps FROM f GROUP BY 1),
walk AS (
  SELECT doc_id, 1 AS i, 0 AS skip, 0 AS sec, false AS found, CAST(NULL AS VARCHAR) AS head, false AS named FROM l WHERE false
  UNION ALL SELECT doc_id, 0, 0, 0, false, NULL, true FROM l
  UNION ALL
  SELECT w.doc_id, w.i + 1, CASE WHEN w.skip > 0 THEN w.skip - 1 ELSE x.taken END, w.sec + CAST(w.skip = 0 AND x.head AS INT), w.found OR (w.skip = 0 AND x.head),
    CASE WHEN w.skip = 0 AND x.head THEN x.title ELSE w.head END, w.skip > 0 OR x.head
  FROM walk w JOIN l USING (doc_id), LATERAL (SELECT p, CASE WHEN NOT p.nl OR NOT coalesce(a.u, false) THEN 0 WHEN NOT coalesce(b.u, false) THEN 1 WHEN NOT coalesce(c.u, false) THEN 2 ELSE 3 END AS n, a, b, c FROM (SELECT ps[w.i + 1] AS p, ps[w.i + 2] AS a, ps[w.i + 3] AS b, ps[w.i + 4] AS c)) y,
    LATERAL (SELECT y.n AS taken, y.n > 0 OR (NOT y.p.nl AND (y.p.ch OR (w.found AND y.p.u))) AS head,
      y.p.text || CASE WHEN y.n > 0 THEN ' ' || y.a.text ELSE '' END || CASE WHEN y.n > 1 THEN ' ' || y.b.text ELSE '' END || CASE WHEN y.n > 2 THEN ' ' || y.c.text ELSE '' END AS title) x
  WHERE w.i < len(l.ps)),
rows AS (SELECT w.doc_id, w.sec, w.head, w.named, length(l.ps[w.i].text) AS n, l.ps[w.i].page AS page, bool_or(w.found) OVER d AND bool_or(NOT w.named) OVER d AS chapters FROM walk w JOIN l USING (doc_id) WHERE w.i > 0 WINDOW d AS (PARTITION BY w.doc_id)),
s AS (SELECT doc_id, chapters, CASE WHEN chapters THEN sec ELSE page END AS k, coalesce(max(head), '') AS head, count(*) FILTER (WHERE NOT (named AND chapters)) AS n_paras, CAST(coalesce(sum(n) FILTER (WHERE NOT (named AND chapters)), 0) AS BIGINT) AS chars FROM rows GROUP BY 1, 2, 3)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS section_no, CASE WHEN NOT chapters THEN 'Página ' || k WHEN k = 0 THEN 'Preliminares' ELSE head END AS title, n_paras, chars FROM s WHERE n_paras > 0"""


def repeated_page(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 2).cast("int").alias("page"), "text", F.col("text").alias("source_text"))
    again = turns.where("doc_id % 3 = 0").withColumns({"page": F.col("page") + 1, "text": F.regexp_replace("text", " ", "  "), "source_text": F.when(F.col("page") % 4 == 0, F.col("text")).otherwise(F.concat("text", F.lit("x")))})
    return layout.repeated_pages(turns.unionByName(again), 100).select("doc_id", "page", "is_repeat")


def coverage_check(spark: SparkSession, d: str) -> DataFrame:
    source = F.concat("text", F.when(F.col("doc_id") % 2 == 0, " ![figure](a.png)").otherwise(""))
    return layout.coverage(_docs(spark, d).select("doc_id", source.alias("source_text"), F.left("text", (F.length("text") * (F.col("doc_id") % 10) / 10).cast("int")).alias("output_text")))


def search_identity(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.search_identity(F.col("text")).alias("identity"))


def device_search(spark: SparkSession, d: str) -> DataFrame:
    return readinglog.device_search(_shelf(spark, d), "ÉLE").select("doc_id", F.length("title").alias("chars"))


def _shelf(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.col("text").alias("title"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_name"), F.lit("").alias("authors"))


def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """Two queries over a written index: words that some texts hold, and one that none does."""
    books = _shelf(spark, d)
    postings = materialize(readinglog.search_postings(books, "doc_id"), "8m")
    found = [readinglog.indexed_search(books, "doc_id", postings, q).select("doc_id", F.lit(q).alias("query")) for q in ("Ción de", "THE the", "zzq")]
    return found[0].unionByName(found[1]).unionByName(found[2])


def toc_links(spark: SparkSession, d: str) -> DataFrame:
    h = _headings(spark, d).select((F.col("page_id") % 20).alias("doc_id"), F.col("page_id").alias("n"), "pos", "title")
    targets = h.select("doc_id", "title", F.concat_ws("-", F.lit("p"), F.col("n").cast("string"), F.col("pos").cast("string")).alias("anchor"))
    k = F.col("n") % 4
    text = F.when(k == 0, F.col("title")).when(k == 1, F.concat("title", F.lit(" ..... "), F.col("n").cast("string"))).when(k == 2, F.concat("title", F.lit("…… xiv "))).otherwise(F.concat("title", F.col("n").cast("string")))
    return links.toc_links(h.select("doc_id", F.col("n").alias("entry_no"), "pos", text.alias("text")), targets).select("doc_id", "entry_no", "pos", "target")


def bookmark_targets(spark: SparkSession, d: str) -> DataFrame:
    h = _headings(spark, d).select((F.col("page_id") % 20).alias("doc_id"), F.col("page_id").alias("page"), "pos", "title", "level", F.concat_ws("-", F.lit("h"), F.col("page_id").cast("string"), F.col("pos").cast("string")).alias("anchor"))
    marks = h.where("doc_id % 3 <> 0").select("doc_id", F.concat(F.lit("* "), "title").alias("title"), F.when(F.col("page") % 4 == 0, F.col("page") + 20).otherwise(F.col("page")).alias("page"), "level")
    return links.book_targets(marks, h)


def anchor_resolution(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    anchors = p.select((F.col("page_id") % 20).alias("doc_id"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("anchor"), F.concat(F.lit("c"), F.floor(F.col("page_id") / 50).cast("string"), F.lit(".xhtml")).alias("chapter"))
    hrefs = p.select((F.col("page_id") % 20).alias("doc_id"), F.col("page_id").alias("link_no"), F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(F.concat(F.lit("#p"), (F.col("page_id") % 20 + F.col("page_id") % 60 * 20).cast("string"))).alias("href"))
    return links.resolve_anchors(hrefs, anchors)


def preview_budget(spark: SparkSession, d: str) -> DataFrame:
    return layout.preview_budget(_lines(spark, d).select("doc_id", F.col("line_no").alias("pos"), "text"))


def page_validation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    cut = F.left("text", (F.length("text") * (50 + k % 51) / 100).cast("int"))
    n = (k % 18).cast("int")
    figure = lambda i: F.struct(F.concat(F.lit("fig-"), (i + 1).cast("string")).alias("id"), F.lit("").alias("alt"), F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.when(k % 17 == 5, 0.95).otherwise(0.5).alias("width"), F.lit(0.25).alias("height"))
    figures = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), figure)).otherwise(F.array().cast(layout.FIGURES))
    images = F.array_join(F.transform(figures, lambda f: F.concat(F.lit("<img data-figure='"), f["id"], F.lit("'>"))), "")
    pages = _docs(spark, d).select(
        "doc_id",
        F.lit(1).alias("expected"),
        F.when(k % 11 == 0, 2).otherwise(1).alias("page"),
        F.concat(F.when(k % 31 == 8, "<script>" + "\ufffd" * 400 + "</script><p>").otherwise("<script>x</script><p>"), T.xml_escape(cut), F.lit("</p>"), F.when(k % 19 == 7, "").otherwise(images), F.when(k % 23 == 9, "\ufffd" * 9).otherwise("")).alias("html"),
        F.lit(False).alias("continues_previous"),
        (k % 29 == 3).alias("join_previous_word"),
        F.lit(False).alias("is_toc"),
        (k % 13 == 0).alias("is_blank"),
        figures.alias("figures"),
        F.col("text").alias("source_text"),
    )
    return materialize(layout.page_reason(pages).select("doc_id", "reason", layout.needs_ocr(F.col("source_text")).alias("needs_ocr")), "2m")


def chapter_numbers(spark: SparkSession, d: str) -> DataFrame:
    marks = _lines(spark, d).select("doc_id", F.col("line_no").alias("pos"), (F.length("text") % 5 == 0).alias("starts"), (F.length("text") % 3 == 0).alias("has_body"))
    return layout.chapter_numbers(marks)


def glossary_dedup(spark: SparkSession, d: str) -> DataFrame:
    from lexweave.operators.catalog import glossary

    words = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "w"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "i"))
    entries = words.select(F.col("conv_id").alias("doc_id"), pos.alias("pos"), F.col("w").alias("source"), F.when(pos % 7 == 0, " ").otherwise(F.concat(F.lit("[ES] "), "w")).alias("target"), F.element_at(F.array(*map(F.lit, ("name", "verb", "title"))), (pos % 3 + 1).cast("int")).alias("type"))
    return glossary(entries)


QUERIES = {f.__name__: f for f in (text_batches, oversize_split, oversize_lossless, batch_context, translation_memory, missing_texts, translation_winner, recombine_fragments, id_set_validation, checkpoint_prefix, html_text_nodes, html_headings, heading_parent, page_headers, page_footers, page_lines, page_paragraphs, section_split, repeated_page, coverage_check, search_identity, device_search, indexed_search, toc_links, bookmark_targets, anchor_resolution, preview_budget, page_validation, chapter_numbers, glossary_dedup)}

ORACLE_SQL = {
    "text_batches": f"WITH RECURSIVE {BATCHES_SQL} SELECT doc_id, batch_no, count(*) AS n_items, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(tokens) AS BIGINT) AS tokens FROM b GROUP BY 1, 2",
    "oversize_split": f"WITH {LINES_SQL} SELECT doc_id, line_no, CAST(p AS INT) AS part, substr(text, p * 1000 + 1, 1000) AS text FROM (SELECT *, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS p FROM lines WHERE length(text) > 1000)",
    "oversize_lossless": f"WITH {LINES_SQL} SELECT doc_id, line_no, text, true AS fits FROM lines",
    "batch_context": f"""WITH RECURSIVE {BATCHES_SQL}, x AS (SELECT doc_id, batch_no, string_agg(text, ' ' ORDER BY line_no) AS t FROM b GROUP BY 1, 2)
SELECT doc_id, batch_no, concat_ws(chr(10) || '---' || chr(10), right(lag(t) OVER w, 700), left(lead(t) OVER w, 700)) AS context, lead(batch_no) OVER w IS NULL AS is_last FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY batch_no)""",
    "translation_memory": f"""WITH {LINES_SQL}, k AS (SELECT DISTINCT text FROM lines WHERE doc_id % 2 = 0)
SELECT doc_id, count(*) AS n_items, count(*) FILTER (WHERE k.text IS NULL) AS n_fallback, CAST(sum(length(l.text) + CASE WHEN k.text IS NULL THEN 0 ELSE 4 END) AS BIGINT) AS chars FROM lines l LEFT JOIN k ON l.text = k.text GROUP BY 1""",
    "missing_texts": f"WITH {LINES_SQL} SELECT DISTINCT text FROM lines WHERE text NOT IN (SELECT text FROM lines WHERE doc_id % 2 = 0 AND length(text) % 2 = 0)",
    "translation_winner": f"""WITH RECURSIVE {BATCHES_SQL}, x AS (SELECT *, doc_id * 100000 + batch_no AS bn FROM b)
SELECT text AS source_text, '[ES]:' || bn || ':' || line_no || ':' || text AS target_text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY bn, line_no DESC) AS n FROM x) WHERE n = 1""",
    "recombine_fragments": f"WITH {LINES_SQL} SELECT doc_id, line_no, text, CAST(ceil(length(text) / 200.0) AS BIGINT) AS n_parts FROM lines",
    "id_set_validation": f"""WITH {LINES_SQL}, s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE line_no % 7 = 3) AS n3, count(*) FILTER (WHERE line_no = 1) AS n1 FROM lines GROUP BY 1),
x AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN n3 WHEN 3 THEN n1 ELSE 0 END AS n_missing, CASE WHEN doc_id % 5 = 3 THEN n1 ELSE 0 END AS n_unexpected, CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END AS n_repeated, CASE WHEN doc_id % 5 = 2 THEN 1 ELSE 0 END AS n_blank FROM s)
SELECT *, n_missing + n_unexpected + n_repeated + n_blank = 0 AS is_valid FROM x""",
    "checkpoint_prefix": f"""WITH {LINES_SQL}, x AS (SELECT doc_id, count(*) FILTER (WHERE line_no < 5) AS m FROM lines GROUP BY 1),
y AS (SELECT doc_id, m, CASE WHEN doc_id % 3 = 1 AND m > 1 THEN m - 1 ELSE m END AS n_saved, CASE WHEN doc_id % 3 = 1 AND m > 1 THEN m - 1 WHEN doc_id % 3 = 2 AND m > 2 THEN m - 1 ELSE m END AS n_same FROM x)
SELECT doc_id, n_saved, n_same, n_same = n_saved AND (n_saved = m OR m = 2) AS is_prefix FROM y""",
    "html_headings": f"WITH {HEADINGS_SQL} SELECT page_id, pos, title, level, {KEY_SQL.format('title')} AS key FROM headings",
    "heading_parent": f"""WITH {LINES_SQL}, m AS (SELECT doc_id, line_no AS pos, CAST(length(text) % 4 + 1 AS INT) AS level FROM lines)
SELECT a.doc_id, a.pos, a.level, (SELECT max(b.pos) FROM m b WHERE b.doc_id = a.doc_id AND b.pos < a.pos AND b.level < a.level) AS parent_pos FROM m a""",
    "page_headers": _edge_sql(3, False),
    "page_footers": _edge_sql(2, True),
    "page_lines": PAGE_LINES_SQL,
    "page_paragraphs": PAGE_PARAGRAPHS_SQL,
    "section_split": SECTIONS_SQL.replace("WITH lines", "WITH RECURSIVE lines", 1),
    "repeated_page": f"""WITH t AS (SELECT conv_id AS doc_id, CAST(turn * 2 AS INT) AS page, text, text AS src FROM conversations UNION ALL SELECT conv_id, CAST(turn * 2 + 1 AS INT), replace(text, ' ', '  '), CASE WHEN turn * 2 % 4 = 0 THEN text ELSE text || 'x' END FROM conversations WHERE conv_id % 3 = 0),
b AS (SELECT *, regexp_replace(text, '[{SPACE}]', '', 'g') AS t FROM t), p AS (SELECT *, lag(t) OVER w AS pt, lag(src) OVER w AS ps, lag(page) OVER w AS pp FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY page))
SELECT doc_id, page, coalesce(pp = page - 1 AND t = pt AND src <> ps AND length(t) > 100 AND length(src) > 100 AND length(ps) > 100, false) AS is_repeat FROM p""",
    "coverage_check": f"""WITH d AS (SELECT doc_id, length(regexp_replace(text, '[{SPACE}]', '', 'g')) AS s, length(regexp_replace(left(text, CAST(floor(length(text) * (doc_id % 10) / 10) AS BIGINT)), '[{SPACE}]', '', 'g')) AS o FROM documents)
SELECT doc_id, s AS source_chars, o AS output_chars, s > 500 AND o < s * 0.55 AS is_rejected FROM d""",
    "search_identity": "SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS identity FROM documents",
    "device_search": "SELECT doc_id, length(text) AS chars FROM documents WHERE contains(strip_accents(lower(text)), 'ele')",
    "indexed_search": "SELECT doc_id, q AS query FROM documents, (VALUES ('Ción de', 'cion de'), ('THE the', 'the the'), ('zzq', 'zzq')) t(q, k) WHERE contains(strip_accents(lower(text)) || ' d' || doc_id || ' ', k)",
    "toc_links": f"""WITH {HEADINGS_SQL}, t AS (SELECT page_id % 20 AS doc_id, {KEY_SQL.format('title')} AS k, count(*) AS n, min('p-' || page_id || '-' || pos) AS a FROM headings GROUP BY 1, 2 HAVING {KEY_SQL.format('title')} <> ''),
e AS (SELECT page_id % 20 AS doc_id, page_id AS entry_no, pos, CASE page_id % 4 WHEN 0 THEN title WHEN 1 THEN title || ' ..... ' || page_id WHEN 2 THEN title || '…… xiv ' ELSE title || page_id END AS text FROM headings),
f AS (SELECT *, {KEY_SQL.format('text')} AS k1, {KEY_SQL.format("regexp_replace(text, '(?i)([.·…]{2,}[ ]*|[ ]+)([0-9]+|[ivxlcdm]+)[ ]*$', '')")} AS k2 FROM e)
SELECT f.doc_id, entry_no, pos, CASE WHEN x.n = 1 THEN x.a WHEN x.n IS NULL AND y.n = 1 THEN y.a END AS target FROM f LEFT JOIN t x ON x.doc_id = f.doc_id AND x.k = k1 LEFT JOIN t y ON y.doc_id = f.doc_id AND y.k = k2""",
    "bookmark_targets": f"""WITH {HEADINGS_SQL}, h AS (SELECT page_id % 20 AS doc_id, page_id AS page, pos, {KEY_SQL.format('title')} AS k, title, level, 'h-' || page_id || '-' || pos AS anchor FROM headings),
f AS (SELECT doc_id, page, k, arg_min(anchor, pos) AS anchor FROM h GROUP BY 1, 2, 3),
m AS (SELECT doc_id, '* ' || title AS title, CASE WHEN page % 4 = 0 THEN page + 20 ELSE page END AS page, level FROM h WHERE doc_id % 3 <> 0)
SELECT m.doc_id, m.title, m.page, m.level, coalesce(f.anchor, 'page-' || m.page) AS target FROM m LEFT JOIN f ON f.doc_id = m.doc_id AND f.page = m.page AND f.k = {KEY_SQL.format('m.title')}
UNION ALL SELECT doc_id, title, page, level, anchor FROM h WHERE doc_id NOT IN (SELECT doc_id FROM m)""",
    "anchor_resolution": """WITH a AS (SELECT page_id % 20 AS doc_id, 'p' || page_id AS anchor, min('c' || CAST(floor(page_id / 50) AS BIGINT) || '.xhtml') AS chapter FROM pages GROUP BY 1, 2),
l AS (SELECT page_id % 20 AS doc_id, page_id AS link_no, CASE WHEN page_id % 5 = 0 THEN url ELSE '#p' || (page_id % 20 + page_id % 60 * 20) END AS href FROM pages)
SELECT l.doc_id, link_no, href, CASE WHEN href NOT LIKE '#%' THEN href WHEN chapter IS NOT NULL THEN chapter || href END AS resolved FROM l LEFT JOIN a ON a.doc_id = l.doc_id AND '#' || a.anchor = l.href""",
    "preview_budget": f"""WITH {LINES_SQL}, x AS (SELECT doc_id, line_no AS pos, text, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lines)
SELECT doc_id, pos, left(text, CAST(2000 - b AS BIGINT)) AS text FROM x WHERE b < 2000""",
    "page_validation": f"""WITH p AS (SELECT doc_id, doc_id % 18 AS nf, left(text, CAST(floor(length(text) * (50 + doc_id % 51) / 100) AS BIGINT)) || CASE WHEN doc_id % 23 = 9 THEN repeat(chr(65533), 9) ELSE '' END AS h, text AS s FROM documents),
q AS (SELECT *, length(regexp_replace(h, '[{SPACE}]', '', 'g')) AS n, length(regexp_replace(s, '[{SPACE}]', '', 'g')) AS o, length(regexp_replace(s, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS letters, length(h) - length(replace(h, chr(65533), '')) + CASE WHEN doc_id % 31 = 8 THEN 400 ELSE 0 END AS bad FROM p)
SELECT doc_id, CASE WHEN doc_id % 11 = 0 OR doc_id % 29 = 3 THEN 'structure' WHEN nf > 16 THEN 'figures' WHEN doc_id % 17 = 5 AND nf > 0 THEN 'figure' WHEN doc_id % 19 = 7 AND nf > 0 THEN 'references'
WHEN CASE WHEN doc_id % 13 = 0 THEN n > 0 OR nf > 0 ELSE n = 0 AND nf = 0 END THEN 'blank' WHEN bad > greatest(2, n * 0.005) THEN 'damaged' WHEN NOT contains(s, chr(65533)) AND letters > o * 0.6 AND o >= 300 AND n < o * 0.65 THEN 'coverage' END AS reason,
length(regexp_replace(s, '\\W', '', 'g')) < 40 AS needs_ocr FROM q""",
    "chapter_numbers": f"""WITH {LINES_SQL}, m AS (SELECT doc_id, line_no AS pos, length(text) % 5 = 0 AS starts, length(text) % 3 = 0 AS has_body FROM lines),
g AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM m),
b AS (SELECT doc_id, g, CAST(coalesce(sum(CAST(bool_or(has_body) AS INT)) OVER (PARTITION BY doc_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chapter_no FROM g GROUP BY doc_id, g)
SELECT g.doc_id, pos, starts, has_body, chapter_no FROM g JOIN b ON g.doc_id = b.doc_id AND g.g = b.g""",
    "glossary_dedup": f"""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations),
e AS (SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS INT) AS pos, trim(w, {TRIM}) AS source, w FROM w),
c AS (SELECT doc_id, pos, source, trim('[ES] ' || w, {TRIM}) AS target FROM e WHERE source <> '' AND pos % 7 <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(source) ORDER BY pos) AS n FROM c)
SELECT doc_id, pos, source, target, CASE pos % 3 WHEN 0 THEN 'name' WHEN 2 THEN 'title' ELSE 'term' END AS type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM f WHERE n = 1) WHERE r <= 100""",
}
