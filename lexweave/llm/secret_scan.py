"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a text is a blob named by its SHA-256. The ledger has for each blob
the rule versions that it was scanned with (``kind:version``) and what they found. A scan first
compares names only: blobs that lack a rule version have one text each
written to the shared folder, however many paths or versions hold them, and just the missing
rules run over those. Findings are joined back to all paths. DataFrame functions only.

A rule is a regular expression whose matches are taken leftmost and
non-overlapping; ``value_group`` and ``least`` drop matches whose value is too
short, after matching. Spans are code points, end exclusive. The base rules are
``assign``, ``access`` and ``hex``; ``private`` (key headers), ``url`` (credentials in a URL) and ``hub``
(hosting tokens) add spans.

Null text counts as empty. Repeated rows each get their findings, and one scan. Null ids pass
through. Matches of a very long text are rows while their places are summed. An empty table gives no
rows. Only the id and text columns are read, so others cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.common import materialize, table


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    value_group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"


BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a whole run of [A-Z0-9] from its first AKIA is one match, so asking for the length in the pattern drops the same ones
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("private", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("url", 1, r"://[^\s/:@]{1,64}:[^\s/:@]{1,128}@"),
    Rule("hub", 1, r"gh[opsur]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + ADDED


FOUND = "array<struct<kind:string,version:int,spans:array<struct<start:int,end:int>>>>"
LEDGER = f"blob string, rules array<string>, found {FOUND}"


def scan_texts(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blobs(blob, text, missing)`` → (blob, found) for blobs with a match of a rule whose name is in ``missing``.

    A split gives the gaps between the matches, asked for only where there are some; places are running sums of
    gaps and matches.
    """

    def matches(k: int, r: Rule) -> Column:
        every = lambda group: F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(group)), F.length)
        sizes = every(0)
        zipped = F.arrays_zip(F.transform(F.split("text", r.pattern, -1), F.length).alias("gap"), sizes.alias("size"), (every(r.value_group) if r.value_group else sizes).alias("value"))
        rows = F.transform(zipped, lambda x, i: F.struct(F.lit(k).alias("rule"), i.alias("pos"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value")))
        return F.when(F.array_contains("missing", r.name) & F.col("text").rlike(r.pattern), rows).otherwise(F.array().cast("array<struct<rule:int,pos:int,gap:int,size:int,value:int>>"))

    each = blobs.select("blob", F.inline(F.concat(*[matches(k, r) for k, r in enumerate(rules)]))).where("size is not null")  # the gap after the last match has none
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("blob", "rule").orderBy("pos"))
    least = F.array(*[F.lit(r.least) for r in rules])
    placed = each.withColumn("end", end.cast("int")).where(F.col("value") >= F.get(least, F.col("rule")))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "end")
    per = placed.groupBy("blob", "rule").agg(F.array_sort(F.collect_list(span)).alias("spans"))  # bounded by one text's matches
    kind, version = F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(r.version) for r in rules])
    item = F.struct(F.get(kind, F.col("rule")).alias("kind"), F.get(version, F.col("rule")).alias("version"), "spans")
    return per.groupBy("blob").agg(F.collect_list(item).alias("found"))


def with_blobs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("blob"))


def update_ledger(docs: DataFrame, names: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of what is scanned now: the blobs ``names(blob)`` of ``docs(blob, text)`` that lack a rule version."""
    every = F.array(*[F.lit(r.name) for r in rules])
    unseen = names.select("blob").distinct()
    if ledger is None:
        unseen, texts = unseen.withColumn("missing", every), docs.withColumn("missing", every)
    else:
        known = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("known"))  # a row for each scan of the blob
        unseen = unseen.join(known, "blob", "left").select("blob", F.array_except(every, F.coalesce("known", F.array().cast("array<string>"))).alias("missing"))
        unseen = materialize(unseen.where("size(missing) > 0"))
        texts = docs.join(unseen, "blob")
    # written before rules run: the filter on a rule would else move to every copy where it is read
    once = materialize(texts.groupBy("blob").agg(F.any_value("text").alias("text"), F.any_value("missing").alias("missing")))
    found = scan_texts(once, rules)
    return unseen.join(found, "blob", "left").select("blob", F.col("missing").alias("rules"), F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): (doc_id, blob, found) for every path, and the ledger to keep for the next scan."""
    docs = with_blobs(docs, id_col, text_col)
    names = materialize(docs.select("doc_id", "blob"))
    current = materialize(update_ledger(docs, names, ledger, rules))
    used = current
    if ledger is not None:
        current = ledger.select("blob", "rules", "found").unionByName(current)
        now = F.array(*[F.lit(r.name) for r in rules])
        used = current.join(names.select("blob").distinct(), "blob", "left_semi").groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"))
        used = used.select("blob", F.filter("found", lambda x: F.array_contains(now, F.concat_ws(":", x["kind"], x["version"].cast("string")))).alias("found"))
    return names.join(used.select("blob", "found"), "blob").select("doc_id", "blob", "found"), current


def digest(findings: DataFrame, order: tuple[str, ...] = tuple(r.kind for r in RULES)) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): counts of the base kinds and spans as text."""
    rank = F.array(*[F.lit(k) for k in order])
    flat = F.flatten(F.transform("found", lambda x: F.transform(x["spans"], lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, x["kind"]).cast("int").alias("rank"), x["kind"].alias("kind"), s["end"].alias("end")))))
    listed = findings.select("doc_id", F.array_sort(flat).alias("every"))
    base = F.filter("every", lambda s: s["kind"].isin([r.kind for r in BASE]))
    number = lambda kind: F.size(F.filter("every", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(r.kind).alias(f"n_{r.kind}") for r in BASE]
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return listed.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"))


def secrets_by_document(docs: DataFrame, **kwargs) -> DataFrame:
    """The digest of :func:`find_secrets` for every row, from a first scan."""
    return digest(find_secrets(docs, **kwargs)[0])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_by_document(table(spark, sf_dir, "documents"))
