"""All queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .harness import duck_query, spark_query
from .many import MANY
from .more import MORE
from .portable import PORTABLE
from .rows import ROWS
from .special import SPECIAL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: spark_query(text) for name, text in PORTABLE.items()} | {name: f for name, (f, _) in {**SPECIAL, **MORE, **MANY, **ROWS}.items()}


def oracle_sql() -> dict[str, str]:
    return {name: duck_query(text) for name, text in PORTABLE.items()} | {name: sql() if callable(sql) else sql for name, (_, sql) in {**SPECIAL, **MORE, **MANY, **ROWS}.items() if sql}
