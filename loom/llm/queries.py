"""The queries of this subpackage, op1 to op13, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module of this package; a module has query(spark, sf_dir) and perhaps ORACLE.
MODULES = {
    "op1_nearest": "ann",
    "op2_packing": "packing",
    "op3_mixing": "mixing",
    "op4_warc": "warc",
    "op5_exact_dedup": "exact_dedup",
    "op6_ngram_join": "ngram_join",
    "op7_toxicity": "toxicity",
    "op8_pseudo_likelihood": "lm",
    "op9_line_dedup": "line_dedup",
    "op10_quality": "quality",
    "op11_url_filter": "url_filter",
    "op12_spelling": "spelling",
    "op13_ball_tree": "ball_tree",
}


def queries() -> dict:
    return {name: import_module(f"loom.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"loom.llm.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
