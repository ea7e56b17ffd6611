"""Markup of extracted pages: safe subsets and plain text, as Arrow-batched functions over one page's markup each."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lexweave.functions.text import normalize_page_text

# Elements that stay, elements that go with all they hold, and elements that end a word.
KEPT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol li table caption thead tbody tfoot tr th td pre code em strong b i u s sup sub br hr span a img figure figcaption aside section div dl dt dd".split())
DROPPED = frozenset("script style iframe object embed link meta base form input button svg".split())
SPACED = frozenset("p li h1 h2 h3 h4 h5 h6 td th blockquote aside figcaption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Attributes that hold small numbers, and roles of notes.
NUMERIC = ("colspan", "rowspan", "start", "value")
NOTES = {"doc-footnote": "footnote", "doc-noteref": "noteref"}
#: Elements before which an open paragraph ends.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol table pre figure figcaption aside section div dl hr form".split())


class Element:
    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


class Fragment(HTMLParser):
    """A tree of the elements and texts of a fragment; comments are left out."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open, self.n_open = [self.root], Counter()
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS and self.n_open["p"]:
            self.handle_endtag("p")
        if tag == "li" and self.open[-1].tag == "li":
            self._leave()
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)
            self.n_open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._leave()

    def _leave(self) -> str:
        tag = self.open.pop().tag
        self.n_open[tag] -= 1
        return tag

    def handle_endtag(self, tag: str) -> None:
        if self.n_open[tag]:
            while self._leave() != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def steps(root: Element, into=lambda e: True) -> Iterator[tuple[Element | str, bool]]:
    """Children in order, at any depth: (child, False) where it begins, (element, True) where one ends that was gone ``into``."""
    stack = [(root, iter(root.children))]
    while stack:
        e, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if stack:
                yield e, True
        else:
            yield child, False
            if isinstance(child, Element) and into(child):
                stack.append((child, iter(child.children)))


def walk(e: Element) -> Iterator[Element | str]:
    return (child for child, ends in steps(e) if not ends)


def plain_text(markup: str) -> str:
    """One line of text; breaks and the ends of blocks are spaces."""
    out = []
    for x, ends in steps(Fragment(markup).root, into=lambda e: e.tag != "br"):
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br" or ends and x.tag in SPACED:
            out.append(" ")
    return re.sub(r"\s+", " ", "".join(out)).strip()


def anchor(page: int, name: str) -> str:
    """An anchor of this page; names that already belong to a page stay."""
    if re.fullmatch(r"page-\d+|p\d+-[a-zA-Z0-9_-]+", name, re.ASCII):
        return name
    return f"p{page}-{re.sub('[^a-zA-Z0-9_-]', '-', name) or 'anchor'}"


def safe_markup(page: int, markup: str, figures: dict[str, str]) -> str:
    """The allowed subset of a page's markup, as XML: other elements are unwrapped, active ones dropped, anchors made the page's own,
    links only inside or to the web, images only the page's ``figures`` (id: description)."""
    return _safe(page, Fragment(markup).root, figures)[0]


def _safe(page: int, root: Element, figures: dict[str, str]) -> tuple[str, str]:
    """(safe markup, the characters between its tags)."""
    seen: set[str] = set()

    def attributes(e: Element) -> dict[str, str]:
        a, out = e.attributes, {}
        if a.get("id"):
            name = a["id"]
            own = anchor(page, name) if name.startswith(f"p{page}-") else f"p{page}-{re.sub('[^a-zA-Z0-9_-]', '-', name) or 'anchor'}"
            if own not in seen:
                seen.add(own)
                out["id"] = own
        href = a.get("href", "").strip() if e.tag == "a" else ""
        if href.startswith("#"):
            out["href"] = f"#{anchor(page, href[1:])}"
        elif re.match(r"(https?://|mailto:)", href, re.IGNORECASE):
            out["href"] = href
        out |= {n: a[n] for n in NUMERIC if re.fullmatch(r"\d{1,4}", a.get(n, ""), re.ASCII)}
        if a.get("role") in NOTES:
            out |= {"epub:type": NOTES[a["role"]], "class": NOTES[a["role"]]}
        if e.tag == "img":
            out |= {"src": f"../images/p{page}-{a['data-figure']}.png", "alt": figures[a["data-figure"]]}
        return out

    def allowed(e: Element) -> bool:
        return e.tag not in DROPPED and not (e.tag == "img" and e.attributes.get("data-figure") not in figures)

    out: list[list[str]] = [[]]  # of the elements that are open
    heads: list[str] = []
    texts: list[str] = []
    for x, ends in steps(root, into=allowed):
        if isinstance(x, str):
            out[-1].append(escape(x, quote=False))
            texts.append(x)
        elif x.tag not in KEPT or not allowed(x):
            continue
        elif not ends:
            heads.append(x.tag + "".join(f' {k}="{escape(v)}"' for k, v in attributes(x).items()))
            out.append([])
        else:
            inside, head = "".join(out.pop()), heads.pop()
            out[-1].append(f"<{head}>{inside}</{x.tag}>" if inside else f"<{head}/>")
    return "".join(out[0]), "".join(texts)


@F.pandas_udf(StringType())
def html_text(markup: pd.Series) -> pd.Series:
    return markup.map(lambda m: None if m is None else plain_text(m))


def _names(figures) -> dict[str, str]:
    return {f["id"]: f["alt"] or "" for f in ([] if figures is None else figures) if f["id"] is not None}


@F.pandas_udf(StringType())
def _sanitized(page: pd.Series, markup: pd.Series, figures: pd.Series) -> pd.Series:
    return pd.Series([None if m is None else safe_markup(int(p), m, _names(f)) for p, m, f in zip(page, markup, figures, strict=True)])


def _short(figures: Column) -> Column:
    return F.transform(figures, lambda f: F.struct(f["id"].alias("id"), f["alt"].alias("alt")))


def sanitize_html(page: Column, markup: Column, figures: Column) -> Column:
    """:func:`safe_markup` of normalised page text; ``figures`` is an array of structs with ``id`` and ``alt``."""
    return _sanitized(page, normalize_page_text(markup), _short(figures))


@F.pandas_udf(StructType([StructField("references", ArrayType(StringType())), StructField("text", StringType())]))
def _facts(page: pd.Series, raw: pd.Series, normal: pd.Series, figures: pd.Series) -> pd.DataFrame:
    references, texts = [], []
    for p, r, n, f in zip(page, raw, normal, figures, strict=True):
        if r is None or p is None or p != p:
            references.append(None)
            texts.append(None)
            continue
        tree = Fragment(r).root
        references.append([e.attributes.get("data-figure") for e in walk(tree) if isinstance(e, Element) and e.tag == "img"])
        texts.append(_safe(int(p), tree if n == r else Fragment(n).root, _names(f))[1])
    return pd.DataFrame({"references": references, "text": texts})


def page_facts(page: Column, markup: Column, figures: Column) -> Column:
    """``references``: ``data-figure`` of every image, in order, null where one has none; ``text``: the characters between the tags of the
    safe markup. One call, and one reading of pages that are in normal form."""
    return _facts(page, markup, normalize_page_text(markup), _short(figures))


def local_anchor(page: Column, name: Column) -> Column:
    own = F.regexp_replace(name, "[^a-zA-Z0-9_-]", "-")
    return F.when(name.rlike(r"\A(page-[0-9]+|p[0-9]+-[a-zA-Z0-9_-]+)\z"), name).otherwise(F.concat(F.lit("p"), page.cast("string"), F.lit("-"), F.coalesce(F.nullif(own, F.lit("")), F.lit("anchor"))))
