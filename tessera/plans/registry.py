"""Name -> query and name -> oracle SQL tables filled by the plan modules."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, list[str]] = {}


def query(name: str, sql: str | None = None, ops: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is its DuckDB oracle (or None)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        OPERATORS[name] = list(ops)
        return fn
    return deco


def load_all():
    """Import every plan module so that its queries register."""
    from . import text_plans, relational_plans, analysis_plans, ml_plans, stream_plans, io_plans  # noqa: F401
    return QUERIES, ORACLE
