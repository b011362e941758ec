"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Module and query of each operator; the SQL, where there is one, is the module's ``opN_sql``.
OPERATORS = {
    "quality_classifier": "op7_quality_classifier",
    "vector_search": "op3_vector_search",
    "chat_format": "op2_chat_format",
    "jaccard_join": "op5_ngram_jaccard",
    "pii": "op8_pii",
    "secret_scan": "op4_secret_scan",
    "mixing": "op1_mixing",
    "packing": "op10_best_fit_packing",
    "quality_rules": "op6_quality_rules",
    "sharding": "op9_sharding",
}


def queries() -> dict[str, Callable]:
    return {name: getattr(import_module(f"strandmill.llm.{module}"), name) for module, name in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for module, name in OPERATORS.items():
        sql = getattr(import_module(f"strandmill.llm.{module}"), f"{name.split('_')[0]}_sql", None)
        if sql:
            found[name] = sql()
    return found
