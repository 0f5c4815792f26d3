"""Registry of this subpackage's queries: name -> (spark, sf_dir) -> DataFrame, and SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict = {}

_MODULES = ["q_near", "q_chat", "q_lines", "q_lm", "q_quality", "q_exact", "q_mix", "q_secrets", "q_urls", "q_pack", "q_ball", "q_ftrl", "q_repair"]


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all():
    for m in _MODULES:
        importlib.import_module(f"polarity.llm.{m}")
    return QUERIES, ORACLE
