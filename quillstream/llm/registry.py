"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: query name -> module of this package that holds query(spark, sf_dir) and, where SQL can express it, ORACLE_SQL
MODULES = {
    "op1_collinear_chaining": "chaining",
    "op2_license_scan": "licenses",
    "op3_kneser_ney_quality": "quality",
    "op4_token_counts": "token_counts",
    "op5_sentencepiece_nbest": "pieces",
    "op6_suffix_array_dedup": "suffix_dedup",
    "op7_maxent_scores": "language_model",
    "op8_site_style_tree": "main_text",
    "op9_simhash_near_dedup": "simhash",
    "op10_benchmark_decontamination": "decontaminate",
}


def queries() -> dict[str, Callable]:
    return {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
