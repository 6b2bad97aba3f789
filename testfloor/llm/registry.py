"""Registered queries of this subpackage and, where SQL can express them, their oracle texts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}
_MODULES = ("queries",)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        if sql is not None:
            _ORACLE[name] = sql
        return function

    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"testfloor.llm.{module}")
    importlib.import_module("corpus_pipeline")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
