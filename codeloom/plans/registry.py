"""Names every query and, where SQL can express it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans.bindings import Bound, with_clause

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_GIVEN: dict[str, str] = {}
_MODULES = ("insights", "scalars", "filters", "joins", "aggregates", "ordering", "text", "graphs", "sinks", "streams", "entities", "api")


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Bound], DataFrame]], Callable[[Bound], DataFrame]]:
    """Registers a query over bound tables under name, with the SQL that must give the same rows.

    The SQL may name bindings like tables; their definitions are put before it.
    """

    def put(f: Callable[[Bound], DataFrame]) -> Callable[[Bound], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: f(Bound(spark, sf_dir))
        if sql is not None:
            _GIVEN[name], _ORACLES[name] = sql, with_clause(sql)
        return f

    return put


def given_sql(name: str) -> str:
    """The SQL of a query that is registered already, bindings undefined, to stand in that of others."""
    return _GIVEN[name]


def _load() -> None:
    for module in _MODULES:
        import_module(f"codeloom.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
