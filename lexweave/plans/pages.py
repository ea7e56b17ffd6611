"""From positioned page text to sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.layout import assemble_lines, assemble_paragraphs, split_sections, strip_footers, strip_headers


def document_sections(items: DataFrame) -> DataFrame:
    """``items(doc_id, page, item_no, str, x, y, height)`` → sections, after page headers and footers went. Pages of blank items count as pages."""
    paras = strip_footers(strip_headers(assemble_paragraphs(assemble_lines(items))))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "para_no"))
    return split_sections(paras.select("doc_id", "page", pos.alias("pos"), "text"), items.select("doc_id", "page").distinct())
