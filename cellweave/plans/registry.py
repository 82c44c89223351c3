"""All queries over the engine's own operators, with the SQL each is compared with.

A query is named after what it computes; its docstring gives the operators of the inventory that it covers.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE_SQL: dict[str, str] = {}
MODULES = ("regulons", "expression", "cells", "geometry", "graphs", "decoding", "texts", "spectra", "affinities", "images", "alignments", "models", "multimodal", "segments", "contracts")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL where SQL can express it."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"cellweave.plans.{name}")


_load_once: list[bool] = []


def __getattr__(name: str) -> dict:
    if name not in ("QUERIES", "ORACLE_SQL"):
        raise AttributeError(name)
    if not _load_once:
        _load_once.append(True)
        _load()
    return _QUERIES if name == "QUERIES" else _ORACLE_SQL
