"""Replies of remote models and what is sent to them: JSON in free text, items, glossaries, pages, prompts, redaction."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ITEMS = "array<struct<id:string,text:string>>"
GLOSSARY = "array<struct<source:string,target:string,type:string>>"
PAGES = "struct<pages:array<struct<page:int,html:string,continuesPrevious:boolean,joinPreviousWord:boolean,isToc:boolean,isBlank:boolean,figures:array<struct<id:string,alt:string,x:double,y:double,width:double,height:double>>>>>"


def json_in(text: str) -> str | None:
    """The JSON of a reply in normal form: the whole text, a fenced block, or the first balanced object or list that can be read.

    None if there is none, or if one is nested deeper than the reader goes.
    """
    decoder = json.JSONDecoder(parse_constant=lambda c: _no(c))
    whole = text.strip()
    fenced = re.search(r"```(?:json)?\s*([\s\S]*?)\s*```", whole, re.IGNORECASE)
    try:
        for candidate in [whole, *([fenced[1].strip()] if fenced else [])]:
            try:
                return json.dumps(decoder.decode(candidate), ensure_ascii=False)
            except ValueError:
                continue
        for m in re.finditer(r"[{\[]", whole):  # what the decoder reads from here is balanced
            try:
                return json.dumps(decoder.raw_decode(whole, m.start())[0], ensure_ascii=False)
            except ValueError:
                continue
    except RecursionError:
        return None
    return None


def _no(constant: str) -> None:
    raise ValueError(constant)


@F.pandas_udf(StringType())
def reply_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else json_in(t))


def reply_items(reply: Column) -> Column:
    """The items of a reply's JSON: itself if a list, else what ``items``, ``translations`` or ``data`` lists, the first of these."""
    v = F.try_parse_json(reply)
    listed = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("ARRAY"), F.from_json(F.to_json(F.try_variant_get(v, path, "variant")), ITEMS))
    return F.coalesce(*[listed(p) for p in ("$", "$.items", "$.translations", "$.data")])


def reply_glossary(reply: Column) -> Column:
    """The entries of a glossary reply: a list, or what ``glossary`` lists; none else."""
    v = F.try_parse_json(reply)
    listed = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("ARRAY"), F.from_json(F.to_json(F.try_variant_get(v, path, "variant")), GLOSSARY))
    return F.coalesce(listed("$"), listed("$.glossary"), F.array().cast(GLOSSARY))


def reply_pages(reply: Column) -> Column:
    """The pages of a transcription, or null; fields of another type are null and fail the page's checks."""
    return F.from_json(without_fence(reply), PAGES)["pages"]


def without_fence(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"(?s)\A```(?:json)?\s*(.*?)\s*```\z", "$1")


def without_images(c: Column) -> Column:
    """Text without linked images of the form ``![...](...)``."""
    return F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", "")


def redacted(c: Column, secret: Column, mark: str = "[redacted]") -> Column:
    return F.when(F.coalesce(secret, F.lit("")) == "", c).otherwise(F.replace(c, secret, F.lit(mark)))


def is_isbn_query(c: Column) -> Column:
    return F.regexp_replace(c, r"[-\s]", "").rlike(r"(?i)\A([0-9]{9}[0-9X]|[0-9]{13})\z")


def catalogue_query(c: Column) -> Column:
    """A query by ISBN where it is one."""
    return F.when(is_isbn_query(c), F.concat(F.lit("isbn:"), F.regexp_replace(c, r"[-\s]", ""))).otherwise(c)


def publication_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\A([0-9]{4})", 1), F.lit("")).cast("int")


def image_container(c: Column) -> Column:
    return F.when(c.startswith("g_"), "common").otherwise("page")


def prompt(items: Column, glossary: Column, context: Column) -> Column:
    """The request for a batch: glossary, context and items as JSON in one text."""
    lines = F.array_join(F.transform(glossary, lambda g: F.concat(F.lit("- "), g["source"], F.lit(" => "), g["target"], F.lit(" ("), g["type"], F.lit(")"))), "\n")
    part = lambda title, c, none: F.concat(F.lit(f"{title}:\n"), F.coalesce(F.nullif(c, F.lit("")), F.lit(none)))
    return F.concat_ws("\n\n", part("Glossary", lines, "(none)"), part("Context, not to be translated", context, "(none)"), F.concat(F.lit("Items:\n"), F.to_json(items)))
