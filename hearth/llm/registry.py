"""Registry of the ``opN_<name>`` queries of this subpackage."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

MODULES = ("mixing", "simhash", "toxicity", "topk", "decontaminate", "langid", "sharding", "chat", "quality",
           "tokencount", "lmscore", "divergence", "phrases")


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"hearth.llm.{m}")
