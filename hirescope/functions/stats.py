"""Aggregation building blocks that stay distributed on skewed or unbounded groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_HALF = 65_536


def count_by(df: DataFrame, *keys: str, n: str = "n") -> DataFrame:
    """Rows per key; null keys are ignored. Combines on the map side, so hot keys are cheap."""
    present = df.dropna(subset=list(keys))
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))


def top(df: DataFrame, k: int, n: str, *names: str) -> DataFrame:
    """The k largest by ``n``, ties by name. Spark keeps k rows per task, not a full sort."""
    return df.orderBy(F.desc(n), *[F.asc(c) for c in names]).limit(k)


def top_per_group(df: DataFrame, group: Sequence[str], k: int, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """First k rows per group. The rank filter lets Spark prune to k per group before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_value(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, order) of the row that comes first per key.

    Rows are first reduced to distinct (key, value) pairs with a hash aggregate
    that combines on the map side; only those few pairs are then compared.
    """
    spelled = df.groupBy(key, value).agg(F.min(order).alias(order))
    return spelled.groupBy(key).agg(F.min_by(value, order).alias(value), F.min(order).alias(order))


def int_summary(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Mean, exact median, smallest and largest of an INT column per group.

    A plain median gathers every value of a group in one task. Here rows are
    first reduced to (value, count); the high 16 bits (at most 65,536 buckets)
    locate the bucket of the middle rows, and only those buckets are then walked
    value by value (at most 65,536 each). No task sees more rows than that per group.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return counted_summary(counted, group)


def counted_summary(counted: DataFrame, group: Sequence[str]) -> DataFrame:
    """:func:`int_summary` of rows (group, _v, _n): each INT value once per group, with how often it occurs."""
    group = list(group)
    counted = counted.withColumn("_hi", F.floor(F.col("_v") / _HALF).cast("int"))
    amount = F.col("_v").cast("decimal(10,0)") * F.col("_n").cast("decimal(20,0)")
    buckets = counted.groupBy(*group, "_hi").agg(
        F.sum("_n").alias("_bn"), F.sum(amount).alias("_sum"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"),
    )
    by_bucket = Window.partitionBy(*group).orderBy("_hi")
    whole = Window.partitionBy(*group)
    located = (
        buckets.withColumns(
            {
                "_upto": F.sum("_bn").over(by_bucket),
                "_total": F.sum("_bn").over(whole),
                "mean": F.sum("_sum").over(whole).cast("double") / F.sum("_bn").over(whole),
                "smallest": F.min("_min").over(whole),
                "largest": F.max("_max").over(whole),
            }
        )
        .withColumn("_before", F.col("_upto") - F.col("_bn"))
        .withColumn("_lo_rank", F.floor((F.col("_total") - 1) / 2))
        .withColumn("_hi_rank", F.floor(F.col("_total") / 2))
        .where(
            F.col("_lo_rank").between(F.col("_before"), F.col("_upto") - 1)
            | F.col("_hi_rank").between(F.col("_before"), F.col("_upto") - 1)
        )
        .select(*group, "_hi", "_before", "_lo_rank", "_hi_rank", "mean", "smallest", "largest")
    )
    in_bucket = Window.partitionBy(*group, "_hi").orderBy("_v")
    walked = (
        counted.join(located, [*group, "_hi"])
        .withColumn("_end", F.col("_before") + F.sum("_n").over(in_bucket))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )

    def at(rank: str) -> Column:
        hit = F.col(rank).between(F.col("_start"), F.col("_end") - 1)
        return F.max(F.when(hit, F.col("_v")))

    middle = (at("_lo_rank").cast("double") + at("_hi_rank").cast("double")) / 2
    return walked.groupBy(*group).agg(
        F.max("mean").alias("mean"),
        middle.alias("median"),
        F.max("smallest").alias("smallest"),
        F.max("largest").alias("largest"),
    )
