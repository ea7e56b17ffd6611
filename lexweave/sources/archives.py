"""ZIP and EPUB archives as tables, and EPUBs written back.

``binaryFile`` gives the archives; a task opens each from its bytes. Archives over the size limit
are passed over before their content is read. Failures become rows with ``error``.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions.text import TRIMMED

MARKUP = r"(?i)\.(x?html|htm|ncx)\z"
SKIPPED = frozenset(("script", "style", "svg", "code", "pre"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENTRIES = "archive string, entry_no int, path string, size long, compressed long, content binary, error string"


def archive_files(spark: SparkSession, path: str, max_bytes: int = 200 << 20) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= max_bytes)


def zip_entries(files: DataFrame, *, max_entries: int = 10_000, max_entry: int = 64 << 20, max_total: int = 512 << 20, max_ratio: int = 1000) -> DataFrame:
    """One row per entry of ``files(path, content)``; an archive that breaks a rule gives one row with ``error``.

    Names, sizes and ratios are judged by the directory before anything is inflated; what is inflated must have the
    size that the directory states.
    """

    def problem(infos: list[zipfile.ZipInfo]) -> str | None:
        names = [posixpath.normpath(i.filename) for i in infos]
        raw = [i.orig_filename for i in infos]
        if len(infos) > max_entries:
            return "too many entries"
        if any(not n or "\0" in n or "\\" in n or n.startswith("/") or n[1:2] == ":" or ".." in n.split("/") for n in raw) or len(set(names)) < len(names):
            return "unsafe or repeated names"
        if any(i.file_size > max_entry for i in infos) or sum(i.file_size for i in infos) > max_total:
            return "too large"
        return "compression ratio" if any(i.file_size > max_ratio * max(i.compress_size, 1) for i in infos) else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("entry_no", pa.int32()), ("path", pa.string()), ("size", pa.int64()), ("compressed", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1), strict=True):
                rows: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(raw.as_py())) as z:
                        if found := problem(z.infolist()):
                            raise ValueError(found)
                        for n, i in enumerate(x for x in z.infolist() if not x.is_dir()):
                            with z.open(i) as f:
                                content = f.read(i.file_size + 1)
                            if len(content) != i.file_size:
                                raise ValueError("size differs from the directory")
                            rows.append((name.as_py(), n, i.filename, i.file_size, i.compress_size, content, None))
                except Exception as e:  # noqa: BLE001  a broken archive is a row, not a failed job
                    rows = [(name.as_py(), None, None, None, None, None, f"{type(e).__name__}: {e}"[:300])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return files.select("path", "content").mapInArrow(read, ENTRIES)


def markup_entries(entries: DataFrame) -> DataFrame:
    """Markup entries of each archive with ``file_idx`` in archive order; an archive without one gives a row with ``error``."""
    kept = entries.where(F.col("path").rlike(MARKUP))
    numbered = kept.withColumn("file_idx", F.row_number().over(Window.partitionBy("archive").orderBy("entry_no")) - 1)
    empty = entries.where("error is null").groupBy("archive").agg(F.count_if(F.col("path").rlike(MARKUP)).alias("n")).where("n = 0").select("archive", F.lit("no markup").alias("error"))
    return numbered.unionByName(empty, allowMissingColumns=True)


BLANK = r"(?:[" + TRIMMED + r"]|&nbsp;|&#160;|&#x[aA]0;)*"
NODE = re.compile(rf"({BLANK})(.*?)({BLANK})\Z", re.DOTALL)


class TextNodes(HTMLParser):
    """Text between tags in document order, without what stands in skipped elements, and where each stands in the source."""

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[str, str, int, int]] = []
        self.open: list[str] = []
        self.held, self.start = "", 0
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.feed(source)
        self.close()
        self.close_node(len(source))

    def here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def close_node(self, end: int) -> None:
        text = self.held.strip(TRIMMED)
        if text and not SKIPPED.intersection(self.open):
            self.nodes.append((self.open[-1] if self.open else "", text, self.start, end))
        self.held = ""

    def handle_starttag(self, tag, attrs):
        self.close_node(self.here())
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.close_node(self.here())

    def handle_endtag(self, tag):
        self.close_node(self.here())
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_comment(self, data):
        self.close_node(self.here())

    def handle_data(self, data):
        if not self.held:
            self.start = self.here()
        self.held += data


def with_texts(source: str, texts: dict[int, str]) -> str:
    """``source`` with the numbered text nodes replaced; tags, attributes, the other nodes and blanks around a text stay as they are."""
    at, out = 0, []
    for k, (_, _, start, end) in enumerate(TextNodes(source).nodes):
        if k in texts:
            before, _, after = NODE.match(source[start:end]).groups()
            out += [source[at:start], before, escape(texts[k], quote=False), after]
            at = end
    return "".join([*out, source[at:]])


def text_nodes(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, node_idx, tag, text) of every page."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, tags, texts = [], [], [], []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (tag, text, _, _) in enumerate(TextNodes(html or "").nodes):
                    ids.append(page), n.append(k), tags.append(tag), texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(n, pa.int32()), pa.array(tags, pa.string()), pa.array(texts, pa.string())], names=[id_col, "node_idx", "tag", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(read, f"`{id_col}` {kind}, node_idx int, tag string, text string")


METADATA = "archive string, title string, authors array<string>, language string, publisher string, description string, cover_path string, error string"


def epub_metadata(entries: DataFrame) -> DataFrame:
    """Dublin Core fields and the cover's path of each archive; the first value of each, all creators."""

    def local(e: ElementTree.Element) -> str:
        return e.tag.rpartition("}")[2]

    def read(group: pd.DataFrame) -> pd.DataFrame:
        row: dict = {"archive": group.archive.iloc[0], "authors": [], "error": None}
        try:
            content = dict(zip(group.path, group.content, strict=True))
            container = ElementTree.fromstring(content["META-INF/container.xml"])
            opf_path = next(e.attrib["full-path"] for e in container.iter() if local(e) == "rootfile")
            opf = ElementTree.fromstring(content[opf_path])
            for e in opf.iter():
                name, text = local(e), (e.text or "").strip()
                if name == "creator" and text:
                    row["authors"].append(text)
                elif name in ("title", "language", "publisher", "description") and text:
                    row.setdefault(name, text)
            items = [e for e in opf.iter() if local(e) == "item"]
            legacy = next((e.attrib.get("content") for e in opf.iter() if local(e) == "meta" and e.attrib.get("name") == "cover"), None)
            covers = [i for i in items if "cover-image" in i.attrib.get("properties", "").split()] + [i for i in items if legacy and i.attrib.get("id") == legacy]
            cover = covers[0] if covers else None
            if cover is not None:
                row["cover_path"] = posixpath.normpath(posixpath.join(posixpath.dirname(opf_path), unquote(cover.attrib.get("href", ""))))
        except Exception as e:  # noqa: BLE001
            row["error"] = f"{type(e).__name__}: {e}"[:300]
        return pd.DataFrame([{c.split()[0]: row.get(c.split()[0]) for c in METADATA.split(", ")}])

    small = entries.where(F.col("path").rlike(r"(?i)(\Ameta-inf/container\.xml|\.opf)\z"))
    return small.groupBy("archive").applyInPandas(read, METADATA)


def rewrite_entries(entries: DataFrame, translated: DataFrame) -> DataFrame:
    """``entries`` with the text nodes of markup entries replaced: ``translated(archive, file_idx, node_idx, text)``."""
    nodes = translated.groupBy("archive", "file_idx").agg(F.map_from_entries(F.collect_list(F.struct("node_idx", "text"))).alias("_new"))
    marked = markup_entries(entries).select("archive", "entry_no", "file_idx").join(nodes, ["archive", "file_idx"]).drop("file_idx")
    joined = entries.join(marked, ["archive", "entry_no"], "left")

    @F.pandas_udf("binary")
    def replace(content: pd.Series, new: pd.Series) -> pd.Series:
        one = lambda raw, texts: raw if texts is None or isinstance(texts, float) else with_texts(raw.decode("utf-8"), dict(texts)).encode()
        return pd.Series([one(c, n) for c, n in zip(content, new, strict=True)])

    return joined.withColumn("content", replace("content", "_new")).drop("_new")


DC = "http://purl.org/dc/elements/1.1/"


def _element(tag: str) -> re.Pattern:
    return re.compile(rf"<((?:[\w.-]+:)?{tag})\b([^>]*?)(?:/>|>(.*?)</\1\s*>)", re.DOTALL)


def edited_package(opf: str, values: dict[str, list[str]]) -> str:
    """A package document with the given values of Dublin Core fields: values take the places of those there, further ones are added,
    those left over go with what refines them. All else stays as it is."""
    block = re.search(r"(<(?:[\w.-]+:)?metadata\b[^>]*>)(.*)(</(?:[\w.-]+:)?metadata\s*>)", opf, re.DOTALL)
    if not block:
        raise ValueError("no metadata")
    head, body, tail = block.groups()
    if "xmlns:dc=" not in opf:
        head = f'{head[:-1]} xmlns:dc="{DC}">'
    for name, given in values.items():
        left = [v.strip() for v in given if v.strip()]
        refined: list[str] = []

        def put(m: re.Match, left: list[str] = left, refined: list[str] = refined) -> str:
            if left:
                return f"<{m[1]}{m[2]}>{escape(left.pop(0), quote=False)}</{m[1]}>"
            own = re.search(r"""\bid=["']([^"']+)["']""", m[2])
            refined.extend([own[1]] if own else [])
            return ""

        body = _element(name).sub(put, body)
        if refined:
            body = _element("meta").sub(lambda m, r=refined: "" if any(f'refines="#{i}"' in m[2] for i in r) else m[0], body)
        body += "".join(f"<dc:{name}>{escape(v, quote=False)}</dc:{name}>" for v in left)
    return opf[: block.start()] + head + body + tail + opf[block.end() :]


FIELDS = {"title": "title", "authors": "creator", "language": "language", "publisher": "publisher", "description": "description"}


def edit_metadata(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """``entries`` with the package documents of the archives in ``edits(archive, title, authors, language, publisher, description)`` edited."""
    joined = entries.join(edits.select("archive", F.struct(*FIELDS).alias("_edit")), "archive", "left")

    @F.pandas_udf("binary")
    def edit(content: pd.Series, change: pd.DataFrame, applies: pd.Series) -> pd.Series:
        out = []
        for raw, row, on in zip(content, change.to_dict("records"), applies, strict=True):
            listed = {tag: list(row[c]) if c == "authors" and row[c] is not None else [row[c] or ""] for c, tag in FIELDS.items() if row[c] is not None}
            out.append(edited_package(raw.decode("utf-8"), listed).encode() if on else raw)
        return pd.Series(out)

    on = F.col("_edit").isNotNull() & F.col("path").rlike(r"(?i)\.opf\z")
    return joined.withColumn("content", edit("content", "_edit", F.coalesce(on, F.lit(False)))).drop("_edit").select(*entries.columns)


def epub_covers(entries: DataFrame) -> DataFrame:
    """(archive, path, content) of the covers that the packages name and the archives hold."""
    named = epub_metadata(entries).where("cover_path is not null").select("archive", F.col("cover_path").alias("path"))
    return entries.select("archive", "path", "content").join(named, ["archive", "path"])


def build_archives(entries: DataFrame) -> DataFrame:
    """(archive, content): each archive's entries zipped in order, ``mimetype`` first and uncompressed."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.assign(first=group.path != "mimetype").sort_values(["first", "entry_no"])
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in zip(rows.path, rows.content, strict=True):
                z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_STORED if path == "mimetype" else zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"archive": [group.archive.iloc[0]], "content": [out.getvalue()]})

    return entries.select("archive", "entry_no", "path", "content").groupBy("archive").applyInPandas(build, "archive string, content binary")  # one archive of bounded size
