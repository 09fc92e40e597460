"""All registered queries and their SQL, collected from the plan modules."""

from __future__ import annotations

import importlib

_MODULES = ("screening", "classifying", "archives", "catalogs", "texts", "files", "streams")
_QUERIES: dict = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLE[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"tidegate.plans.{m}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values) -> str:
    """A SQL list literal of strings."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"
