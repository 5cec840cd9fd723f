"""Registered queries, each a Spark plan with, where SQL can express it, its DuckDB twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .dialect import duck_sql, spark_sql

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, covers: str, oracle: str | None = None):
    """Registers the decorated (spark, sf_dir) function, the operators it covers, and its twin in the common notation."""

    def keep(f):
        QUERIES[name], COVERS[name] = f, covers
        if oracle:
            ORACLES[name] = duck_sql(oracle)
        return f

    return keep


def both(name: str, covers: str, text: str) -> None:
    """Registers a query that the common notation expresses for both engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(spark_sql(text))

    register(name, covers, text)(run)


def _load() -> None:
    from . import code_rows, dedup, gates, metrics, procedural, projections, relational, sampling, shapes, similarity, storage, streams, upserts  # noqa: F401


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)
