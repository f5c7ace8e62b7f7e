"""Registered queries of the engine and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a query ``f(spark, sf_dir)`` and its oracle SQL."""

    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return add


def queries() -> dict:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["assemble_transcripts"](spark, sf_dir)


def _load() -> None:
    from importlib import import_module

    for name in ("reads", "contigs", "graph", "walks", "assembly"):
        import_module(f"readloom.plans.{name}")


_load()
