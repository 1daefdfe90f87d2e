"""Runs portable queries in Spark, and their text for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLE = re.compile(r"@(\w+)")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The query over the tables in ``sf_dir``; each becomes a temporary view that only this text's names refer to."""
    for name in sorted(set(TABLE.findall(text))):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"tidemill_{name}")
    return spark.sql(TABLE.sub(r"tidemill_\1", text))


def spark_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, text)


def duck_query(text: str) -> str:
    """DuckDB's words for the few functions and joins that are named differently."""
    out = TABLE.sub(r"\1", text)
    out = re.sub(r"LEFT (ANTI|SEMI) JOIN", r"\1 JOIN", out)
    out = re.sub(r"element_at\((\w+), (\d+)\)", r"\1[\2]", out)
    out = out.replace("startswith(", "starts_with(")
    out = re.sub(r"sha2\((.+?), 256\)", r"sha256(\1)", out)
    return out
