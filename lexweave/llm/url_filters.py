"""URL block and allow rules, carried over to aliases of a page.

A page's aliases are the URLs tied to it by canonical links and redirects
(``<link rel=canonical>``, ``<meta http-equiv=refresh>``), followed both ways through any number
of steps: connected components of these edges. URLs are one node if they differ in
scheme, fragment or ``utm_`` parameters only.

A rule (host, path, verdict) fits its host and all subdomains, if the path starts
with the rule's; of those that fit the longest wins. A page under a rule has the
rule's verdict, so an explicit allow always stands. A page under no rule is
blocked if some alias is blocked by a rule and none is explicitly allowed by one; else it
is allowed. Targets that were never crawled count as aliases too.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
path: from there up to ``?``, ``#`` or the end. A null url or one without ``://`` has
neither, no rule and no alias. Null html: no edges. Repeated rows are judged one
by one. An empty table gives no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import materialize, table
from lexweave.llm.components import connected_components

RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(df: DataFrame, url: str, name: str) -> DataFrame:
    """``df`` with ``<name>_rest`` (after ``://``, else null), ``_site``, ``_host``, ``_path`` and ``_node``: the identity of a URL in the graph.

    Step by step, so that each part is computed once.
    """
    rest, site, path, query = (F.col(f"{name}_{c}") for c in ("rest", "site", "path", "query"))
    at = F.instr(url, "://")
    df = df.withColumn(f"{name}_rest", F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))))
    df = df.withColumns({f"{name}_site": F.regexp_extract(rest, r"\A[^/?#]*", 0), f"{name}_path": F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit("")), f"{name}_query": F.regexp_extract(rest, r"(?s)\A[^?#]*(\?[^#]*)", 1)})
    query = F.regexp_replace(F.regexp_replace(query, r"(?<=[?&])utm_[^&]*(&|\z)", ""), r"[?&]\z", "")
    df = df.withColumns({f"{name}_host": F.coalesce(F.translate(site, UPPER, LOWER), F.lit("")), f"{name}_query": query})
    node = F.concat(F.col(f"{name}_host"), F.when(path == "", "/").otherwise(path), F.col(f"{name}_query"))
    return df.withColumn(f"{name}_node", F.when(rest.isNotNull(), node)).drop(f"{name}_query")


def with_target(df: DataFrame) -> DataFrame:
    """``to``: what a page writes as ``target``, seen from the page's ``base_site``, ``base_path`` and ``scheme``, as an absolute URL."""
    df = df.withColumn("written", F.regexp_replace(F.regexp_replace("target", r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""), "&amp;", "&"))
    df = df.withColumns({"kind": F.regexp_extract("written", r"(?i)\A(https?://|//|[a-z][a-z0-9+.-]*:|/|\?|#|\z|)", 1), "folder": F.regexp_extract("base_path", r"(?s)\A.*/", 0), "from": F.concat("scheme", F.lit("://"), "base_site")})
    kind, written, site = F.lower("kind"), F.col("written"), F.col("from")
    to = (
        F.when(kind.isin("http://", "https://"), written)
        .when(kind == "//", F.concat("scheme", F.lit(":"), written))
        .when(kind.endswith(":") | (kind == "#") | (written == ""), F.lit(None).cast("string"))
        .when(kind == "/", F.concat(site, written))
        .when(kind == "?", F.concat(site, F.col("base_path"), written))
        .otherwise(F.concat(site, F.when(F.col("folder") == "", "/").otherwise(F.col("folder")), written))
    )
    return df.withColumn("to", to)


VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)[\s/]{name}{VALUE}"
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v) between nodes, from the canonical links and redirects of ``pages(url, html)``."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.filter(tags, lambda t: t.rlike(r"(?i)\A<link") & _attribute(t, "rel").rlike(r"(?i)(\A|\s)canonical(\s|\z)"))
    refresh = F.filter(tags, lambda t: t.rlike(r"(?i)\A<meta") & _attribute(t, "http-equiv").rlike(r"(?i)\A\s*refresh\s*\z"))
    written = F.concat(
        F.transform(canonical, lambda t: _attribute(t, "href")),
        F.transform(refresh, lambda t: F.regexp_extract(_attribute(t, "content"), r"(?is);\s*url\s*=\s*['\"]?([^'\"]*)", 1)),
    )
    linked = pages.where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)canonical|refresh"))
    # written twice, as a condition on a place would bring all its expressions into one method, beyond Java's bound
    base = with_parts(linked.select("url", "html", F.substring_index("url", "://", 1).alias("scheme")), "url", "base")
    found = materialize(base.select("scheme", "base_site", "base_path", "base_node", F.explode(written).alias("target")))
    targets = with_target(found).select(F.col("base_node").alias("u"), "to").distinct()
    return materialize(with_parts(targets, "to", "to").select("u", F.col("to_node").alias("v"))).where("v is not null and u <> v")


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct ``places(host, path)`` that some rule fits.

    A place is looked up by each suffix of its host and each prefix of its path
    that has the length of some rule's path: equal keys only, however many rules there are.
    """
    rules = rules.select(F.col("host").alias("rh"), F.col("path").alias("rp"), "verdict")
    lengths = F.array(*[F.lit(r["n"]) for r in rules.select(F.length("rp").alias("n")).distinct().collect()] or [F.lit(0)])  # below the longest rule's length
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    keys = places.where("host <> ''").distinct().withColumn("rh", F.explode(suffixes)).withColumn("_n", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))))
    keys = keys.withColumn("rp", F.expr("left(path, _n)"))
    fits = keys.join(rules, ["rh", "rp"]).withColumn("rule", F.concat("rh", "rp"))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("allow"), F.col("rule"), F.col("verdict"))).alias("b")
    return fits.groupBy("host", "path").agg(best).select("host", "path", "b.rule", "b.verdict")


def judge_pages(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, component) for every row of ``pages``."""
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    component = connected_components(alias_edges(pages))
    nodes = with_parts(component.withColumn("at", F.concat(F.lit("x://"), "node")), "at", "at").select("node", "component", F.col("at_host").alias("host"), F.col("at_path").alias("path"))
    ruled = nodes.join(match_rules(nodes.select("host", "path"), rules), ["host", "path"], "left")
    spread = ruled.groupBy("component").agg(F.bool_or(F.col("verdict") == "block").alias("block"), F.bool_or(F.col("verdict") == "allow").alias("allow"))
    spread = spread.select("component", (F.coalesce("block", F.lit(False)) & ~F.coalesce("allow", F.lit(False))).alias("spreads"))
    aliases = component.join(spread, "component").select("node", "component", "spreads")
    own = with_parts(pages.select("page_id", "url"), "url", "url").select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_node").alias("node"))
    places = own.select("host", "path")
    judged = own.join(match_rules(places, rules), ["host", "path"], "left").join(aliases, "node", "left")
    verdict = F.when(F.col("verdict").isNotNull(), F.col("verdict")).when(F.col("spreads"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge_pages(table(spark, sf_dir, "pages"), rules)
