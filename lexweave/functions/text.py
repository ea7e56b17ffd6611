"""Column functions over text. Everything here is a built-in expression except the two pandas UDFs for Unicode forms."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: what a browser's trim() strips.
TRIMMED = "\t\n\x0b\x0c\r \xa0                　﻿"


def trim_all(c: Column) -> Column:
    return F.trim(c, F.lit(TRIMMED))


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim_all(c), F.lit(""))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units; differs from ``length`` for characters beyond the basic plane."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(c) / F.lit(4))).cast("long")


def title_key(c: Column) -> Column:
    """Letters and digits of a title, in lower case, after its page text was normalised."""
    return F.regexp_replace(F.lower(normalize_page_text(c)), r"[^\p{L}\p{N}]", "")


def normalized_isbn(c: Column) -> Column:
    x = F.upper(F.regexp_replace(c, "[^0-9Xx]", ""))
    return F.when(F.length(x).isin(10, 13), x)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


#: Combining marks; none stands below U+0300.
_MARKS = np.array([n for n in range(0x300, 0x110000) if unicodedata.combining(chr(n))], "<u4")


def without_accents(x: str | None) -> str | None:
    if x is None or x.isascii():
        return x
    c = np.frombuffer(unicodedata.normalize("NFD", x).encode("utf-32-le"), "<u4")
    high = np.flatnonzero(c >= 0x300)
    return np.delete(c, high[np.isin(c[high], _MARKS)]).tobytes().decode("utf-32-le")


@F.pandas_udf(StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    return s.map(without_accents)


def search_identity(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", " "))


def search_key(c: Column) -> Column:
    return F.lower(strip_accents(c))


def xml_escape(c: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def section_slug(c: Column, ordinal: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")
    return F.coalesce(F.nullif(x, F.lit("")), F.concat(F.lit("section-"), ordinal.cast("string")))


#: Fixed value: the white space of the language that the rules come from, inside a character class.
JS_SPACE = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def without_spaces(c: Column) -> Column:
    return F.regexp_replace(c, f"[{JS_SPACE}]", "")


def without_page_number(c: Column) -> Column:
    """A contents line without its page number, arabic or roman, after two dots at least or a space."""
    return trim_all(F.regexp_replace(c, rf"(?i)(?:[.·…]{{2,}}[{JS_SPACE}]*|[{JS_SPACE}]+)(?:[0-9]+|[ivxlcdm]+)[{JS_SPACE}]*\z", ""))


def hard_pieces(c: Column, size: int) -> Column:
    """Pieces of ``size`` characters; an empty text gives none."""
    count = F.ceil(F.length(c) / F.lit(size)).cast("int")
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(c, (i - 1) * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def clean_translation(c: Column) -> Column:
    """Without a language mark or heading that a model put before the text, blanks collapsed, trimmed."""
    s = f"[{JS_SPACE}]*"
    x = F.regexp_replace(nfc(c), rf"(?iu)\A{s}(?:\[(?:es|spanish|español)\]|(?:traducción|translation){s}:){s}", "")
    x = F.regexp_replace(x, rf"(?iu)\A{s}(?:traducción|translation){s}:{s}", "")
    return trim_all(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r" ?\n ?", "\n"))


# Ligatures and what they stand for.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))


def normalize_page_text(c: Column) -> Column:
    x = nfc(c)
    for ligature, letters in LIGATURES:
        x = F.replace(x, F.lit(ligature), F.lit(letters))
    return F.regexp_replace(F.replace(x, F.lit("­"), F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "")


def sha256_with_config(content: Column, config: str) -> Column:
    return F.sha2(F.concat(content.cast("binary"), F.lit(config).cast("binary")), 256)


def output_file_name(c: Column, prefix: str = "translated-", extension: str = ".epub", limit: int = 200) -> Column:
    """The last part of a path as an output name of at most ``limit`` characters: other characters than ``A-Za-z0-9._-`` are hyphens,
    the extension is replaced, and longer names end with 12 hex digits of a hash."""
    name = F.regexp_replace(F.substring_index(F.regexp_replace(c, "/+$", ""), "/", -1), "[^a-zA-Z0-9._-]", "-")
    base = F.regexp_replace(name, r"\.[^.]+\z", "")
    room = limit - len(prefix) - len(extension)
    short = F.concat(F.left(base, F.lit(room - 13)), F.lit("-"), F.left(F.sha2(name, 256), F.lit(12)))
    return F.concat(F.lit(prefix), F.when(F.length(base) > room, short).otherwise(base), F.lit(extension))


def file_title(c: Column) -> Column:
    """A book file's name as struct (title, authors): without extension and a trailing id, cut at ``" -- "``."""
    stem = F.regexp_replace(F.regexp_replace(c, r"\.[^.]+\z", ""), r"(?i)_[A-Z0-9]{10,}\z", "")
    stem = trim_all(F.replace(stem, F.lit("_"), F.lit(" ")))
    parts = F.filter(F.transform(F.split(stem, rf"[{JS_SPACE}]+--[{JS_SPACE}]+"), trim_all), lambda x: x != "")
    return F.struct(F.coalesce(F.get(parts, F.lit(0)), stem).alias("title"), F.slice(parts, 2, 1).alias("authors"))


def imported_title(c: Column) -> Column:
    """A title taken from a file: what stands before ``" -- "``, and hyphened words as a sentence."""
    x = trim_all(F.replace(F.get(F.split(c, rf"[{JS_SPACE}]+--[{JS_SPACE}]+"), F.lit(0)), F.lit("_"), F.lit(" ")))
    words = F.replace(x, F.lit("-"), F.lit(" "))
    return F.when(x.rlike(r"\A[\p{IsLatin}\p{N}]+(-[\p{IsLatin}\p{N}]+)+\z"), F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, F.lit(2), F.length(words)))).otherwise(x)


def is_safe_archive_path(c: Column) -> Column:
    """Relative, without empty, ``.`` or ``..`` parts, backslashes, NUL or drive letters."""
    return (F.length(c) > 0) & ~c.rlike(r"\A/|\\|\x00|\A[A-Za-z]:|(\A|/)\.{0,2}(/|\z)")


def is_reading_date(c: Column) -> Column:
    """A day that exists, alone or with a time to the second and a zone."""
    day = F.try_to_timestamp(F.left(c, F.lit(10)), F.lit("yyyy-MM-dd"))
    clock = r"(([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,3})?|24:00:00(\.0{1,3})?)"
    return F.coalesce(c.rlike(rf"\A\d{{4}}-\d{{2}}-\d{{2}}(T{clock}(Z|[+-]([01]\d|2[0-3]):[0-5]\d))?\z") & day.isNotNull(), F.lit(False))


def duration_text(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.when(s >= 3600, F.format_string("%d h %d min", F.floor(s / 3600), F.floor(s % 3600 / 60))).when(s >= 60, F.format_string("%d min %d s", F.floor(s / 60), s % 60)).otherwise(F.format_string("%d s", s))


def progress_percent(current: Column, total: Column, done: Column) -> Column:
    """Whole percent; 100 only when done."""
    p = F.floor(F.lit(100) * current / F.greatest(total, F.lit(1)))
    return F.when(done, 100).otherwise(F.least(F.greatest(p, F.lit(0)), F.lit(99))).cast("int")


def pixel_box(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> Column:
    """A fractional box as whole pixels inside the page, one pixel wide and high at least."""
    left, top = F.floor(F.greatest(x, F.lit(0.0)) * width), F.floor(F.greatest(y, F.lit(0.0)) * height)
    left, top = F.least(left, F.lit(width - 1)), F.least(top, F.lit(height - 1))
    return F.struct(
        left.cast("int").alias("left"),
        top.cast("int").alias("top"),
        F.greatest(F.lit(1), F.least(F.ceil(w * width), width - left)).cast("int").alias("width"),
        F.greatest(F.lit(1), F.least(F.ceil(h * height), height - top)).cast("int").alias("height"),
    )
