"""Name -> (query, SQL). A query is a callable (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = in_utc
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def seconds(c: str) -> Column:
    """A timestamp as text, the same in both engines."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def joined(c: str | Column, alias: str | None = None) -> Column:
    return F.array_join(c, "|").alias(alias or c)
