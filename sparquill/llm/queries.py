"""Registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_decontaminate": "decontaminate",
    "op2_quality_rules": "quality",
    "op3_jaccard_join": "jaccard_join",
    "op4_hilbert_shards": "hilbert",
    "op5_preference_pairs": "preference",
    "op6_language_id": "langid",
    "op7_packing": "packing",
    "op8_simple8b": "simple8b",
    "op9_ctw": "ctw",
    "op10_line_dedup": "linededup",
    "op11_periodic": "periodic",
    "op12_bpe": "bpe",
    "op13_repair": "repair",
}
#: More queries of the operators' modules, with the names of their SQL.
_MORE = {"quality_ablation": ("quality", "ABLATION"), "decontamination_recall": ("decontaminate", None)}


def _query(module: str, name: str):
    return getattr(import_module(f"{__package__}.{module}"), name)


def queries() -> dict:
    return {name: _query(module, name) for name, module in _MODULES.items()} | {name: _query(module, name) for name, (module, _) in _MORE.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in _MODULES.items():
        sql = getattr(import_module(f"{__package__}.{module}"), "ORACLE", None)
        if sql:
            found[name] = sql
    return found | {name: _query(module, sql) for name, (module, sql) in _MORE.items() if sql}
