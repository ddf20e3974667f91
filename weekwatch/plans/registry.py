"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def normal(df: DataFrame) -> DataFrame:
    """Integers as bigint and zone-free timestamps as plain ones, so that both engines name the same types."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint").alias(f.name)
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double").alias(f.name)
        out.append(c)
    return df.select(*out)


def query(name: str, oracle: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function under a name."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normal(fn(spark, sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap
