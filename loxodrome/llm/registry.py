"""Queries and SQL of this subpackage, by the names under which __spark_entry__.py registers them."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_imatch": "op01_imatch",
    "op2_risk_controlled_quality": "op02_quality",
    "op3_bpe_trie": "op03_bpe",
    "op4_minhash_forest": "op04_jaccard",
    "op5_packing": "op05_packing",
    "op6_line_windows": "op06_lines",
    "op7_suffix_tree_lm": "op07_pst",
    "op8_sparse_suffix_array": "op08_suffix",
    "op9_crf_toxicity": "op09_toxicity",
    "op10_debruijn": "op10_debruijn",
}
_LOADED = {name: importlib.import_module(f".{module}", __package__) for name, module in _MODULES.items()}


def queries() -> dict:
    return {name: module.query for name, module in _LOADED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _LOADED.items() if module.ORACLE_SQL}
