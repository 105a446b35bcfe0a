"""Registry of named queries (Spark side) and their DuckDB SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from hearth.plans import (  # noqa: F401
        q_cluster,
        q_profile,
        q_kproto,
        q_quota,
        q_text,
        q_refine,
        q_sweep,
        q_clean,
        q_persona,
        q_guides,
    )
