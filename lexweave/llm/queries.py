"""The queries of this subpackage: one for each operator."""

from __future__ import annotations

from lexweave.llm import ann, decontam, hard_negatives, jaccard_join, lexical, line_dedup, lm_scoring, mixing, packing, quality, secret_scan, substring_dedup, url_filters
from lexweave.llm.sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_url_aliases": url_filters.query,
    "op3_maxent_lm": lm_scoring.query,
    "op4_quality_pu": quality.query,
    "op5_packing": packing.query,
    "op6_compact_windows": substring_dedup.query,
    "op7_secret_ledger": secret_scan.query,
    "op8_decontamination": decontam.query,
    "op9_multiprobe_ann": ann.query,
    "op10_ngram_jaccard": jaccard_join.query,
    "op11_vantage_negatives": hard_negatives.query,
    "op12_tiered_search": lexical.query,
    "op13_pivotal_mix": mixing.query,
}
