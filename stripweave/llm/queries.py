"""Queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_packing": "packing",
    "op2_katz_lm": "katz",
    "op3_quality_trees": "quality_trees",
    "op4_line_rules": "line_rules",
    "op5_mixing": "mixing",
    "op6_line_dedup": "line_dedup",
    "op7_langid": "langid",
    "op8_hilbert_ann": "hilbert_ann",
    "op9_wrapper_text": "wrapper_html",
    "op10_simhash": "simhash",
    "op11_decontamination": "decontamination",
    "op12_centroids": "bisector_clusters",
    "op13_prefix_trie": "prefix_trie",
}


def _late(module: str, name: str):
    def query(spark, sf_dir):
        return getattr(importlib.import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    query.__name__ = name
    return query


def queries() -> dict:
    return {name: _late(module, name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.SQL
