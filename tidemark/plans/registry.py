"""All registered queries of the disclosure engine, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bridge import Tables, sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_LIKE: dict[str, str] = {}


def query(name: str, oracle: str | None = None, *views: str) -> Callable:
    """Registers a function of Tables as a query; `oracle` is DuckDB SQL over the provided tables and the named domain views."""

    def wrap(f: Callable[[Tables], DataFrame]) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle is not None:
            _SQL[name] = sql(oracle, *views)
        return f

    return wrap


def query_like(name: str, other: str) -> Callable:
    """Registers another way to the rows of a query that has its SQL already."""

    def wrap(f: Callable[[Tables], DataFrame]) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        _LIKE[name] = other
        return f

    return wrap


def _load() -> None:
    from . import catalog_queries, catalog_rules, catalog_scalars, catalog_stored  # noqa: F401  they register themselves


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["ord01_search_page"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL | {name: _SQL[other] for name, other in _LIKE.items()}
