"""The registered queries and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def add(name: str, run, sql: str | None) -> None:
    if name in _QUERIES:
        raise ValueError(f"two queries called {name}")
    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


def query(sql: str | None = None):
    """Register a function ``(spark, folder)`` under its own name."""

    def register(f):
        add(f.__name__, f, sql)
        return f

    return register


def queries() -> dict:
    from graphloom.plans import catalogue, catalogue_files, catalogue_texts  # noqa: F401 (they register)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
