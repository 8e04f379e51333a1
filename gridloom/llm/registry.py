"""Queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

import importlib

_WHERE = {
    "op1_language_mixture": "langid",
    "op2_mixing": "mixing",
    "op3_line_dedup": "line_dedup",
    "op4_pseudo_likelihood": "lm_score",
    "op5_near_duplicates": "minhash",
    "op6_embedding_links": "nndescent",
    "op7_token_blocks": "token_blocks",
    "op8_toxicity": "toxicity",
    "op9_quality": "quality",
    "op10_decontaminate": "decontaminate",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"gridloom.llm.{where}"), name) for name, where in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, where in _WHERE.items():
        sql = getattr(importlib.import_module(f"gridloom.llm.{where}"), "SQL", None)
        if sql:
            found[name] = sql
    return found
