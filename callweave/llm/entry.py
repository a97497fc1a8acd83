"""Queries and oracle SQL of the training-data operators, by registered name."""

from __future__ import annotations

from importlib import import_module

#: name -> (module, function, name of the module's oracle SQL or None)
_QUERIES = {
    "op1_url_filter": ("url_filter", "op1_url_filter", "ORACLE"),
    "op2_packing": ("packing", "op2_packing", None),
    "op3_neardup": ("neardup", "op3_neardup", None),
    "op4_matroska": ("matroska", "op4_matroska", None),
    "op9_langid": ("langid", "op9_langid", None),
    "op10_substrings": ("substrings", "op10_substrings", None),
    "op5_simhash": ("simhash", "op5_simhash", None),
    "op6_secrets": ("secrets", "op6_secrets", None),
    "op7_pii": ("pii", "op7_pii", None),
    "op8_byte_bpe": ("bpe", "op8_byte_bpe", None),
    "op11_search": ("balltree", "op11_search", "ORACLE"),
    "op12_negatives": ("negatives", "op12_negatives", "ORACLE"),
    "op13_licences": ("licences", "op13_licences", None),
}


def queries() -> dict:
    found = {name: getattr(import_module(f"callweave.llm.{m}"), f) for name, (m, f, _) in _QUERIES.items()}
    return {"pipeline": import_module("corpus_pipeline").run, **found}


def oracle_sql() -> dict:
    return {name: getattr(import_module(f"callweave.llm.{m}"), o) for name, (m, _, o) in _QUERIES.items() if o}
