"""What a page shows of rows: progress, phases, colours, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours of plain covers, and words of an error or a message that tell its kind, in order.
COLOURS = ("#345c52", "#b45e42", "#344e68", "#887047", "#78566b", "#576746")
ERRORS = (("balance", r"402|saldo insuficiente|insufficient balance"), ("key", r"401|clave|api key|unauthorized"))
PHASES = (
    ("ocr", "ocr"),
    ("glossary", "glosario"),
    ("review", "revisando"),
    ("packaging", "generando epub|construyendo capítulos|empaquetando"),
    ("translation", "traduciendo|traducción"),
    ("pdf", "pdf|página|pagina"),
    ("extraction", "leyendo epub"),
)


def _kind(c: Column, rules: tuple, otherwise: str) -> Column:
    text = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(*[F.when(text.rlike(pattern), name) for name, pattern in rules], F.lit(otherwise))


def error_kind(c: Column) -> Column:
    """What helps: a balance, a key, or to resume."""
    return _kind(c, ERRORS, "resume")


def phase(c: Column) -> Column:
    return _kind(c, PHASES, "processing")


def cover_colour(title: Column) -> Column:
    """One of the colours by the sum of the title's characters (their first UTF-16 unit); without a title the first."""
    first = lambda x: F.when(F.ascii(x) > 0xFFFF, 0xD800 + F.shiftright(F.ascii(x) - 0x10000, 10)).otherwise(F.ascii(x))
    total = F.aggregate(F.filter(F.split(F.coalesce(title, F.lit("")), ""), lambda x: x != ""), F.lit(0).cast("long"), lambda s, x: s + first(x))
    return F.element_at(F.array(*map(F.lit, COLOURS)), (total % len(COLOURS) + 1).cast("int"))


def clamped_progress(done: Column, total: Column) -> Column:
    return F.struct(F.greatest(F.lit(0), F.least(done, total)).alias("current"), F.greatest(F.lit(1), total).alias("total"))


def progress_value(state: Column, current: Column, total: Column) -> Column:
    """Whole percent: 100 only when done, 99 at most before, null without a total or while uploading."""
    percent = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(current / total * 100))).cast("int")
    known = F.coalesce(total > 0, F.lit(False)) & (state != "uploading")
    return F.when(state == "done", 100).when(known, F.when(state.isin("processing", "paused") & (current >= total), 99).otherwise(percent))


def bar_height(count: Column, most: Column) -> Column:
    """Pixels of a month's bar, of the fullest month's."""
    return 6 + count / F.greatest(F.lit(1), most) * 27


def month_label(key: Column) -> Column:
    """A month key as ``January 2026``, whatever the time zone; ``undated`` stays."""
    return F.when(key == "undated", key).otherwise(F.date_format(F.to_date(F.concat(key, F.lit("-01"))), "MMMM yyyy"))


def month_start(month: Column) -> Column:
    """What a month picker stores: the first moment of the month in UTC, null if cleared."""
    return F.when(month != "", F.concat(month, F.lit("-01T00:00:00.000Z")))


def neighbour(index: Column, step: Column, size: Column) -> Column:
    """The place ``step`` further on a ring of ``size``."""
    return F.when(size > 0, F.pmod(index + step, size))
