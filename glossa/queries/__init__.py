"""The query catalogue: each query by name, with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import curation, evaluation, jobs, linking, ner, text

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (text, curation, ner, linking, evaluation, jobs)


def queries() -> dict[str, Query]:
    return {name: fn for m in _MODULES for name, (fn, _) in m.CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.CATALOGUE.items() if sql}
