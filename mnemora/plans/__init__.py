"""Registered queries, by family, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

FAMILIES = [
    "text_plans",
    "confidence_plans",
    "classify_plans",
    "search_plans",
    "store_plans",
    "conversation_plans",
    "streaming_plans",
    "model_plans",
]


def registry() -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for family in FAMILIES:
        module = importlib.import_module(f"mnemora.plans.{family}")
        queries.update(module.Q)
        sql.update(module.S)
    return queries, sql
