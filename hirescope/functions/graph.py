"""Connected components over edges of numbers, and joins in which no key is hot.

A key that holds more than a thousandth of all rows is hot; there are fewer than a
thousand such keys whatever the input, so their side of a join is broadcast. All
other keys meet by a plain shuffle, in groups of at most a thousandth of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirescope.session import materialize

HOT_SHARE = 1000


def join_counted(rows: DataFrame, table: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``rows`` joined with the written ``table`` (key, columns, _n) on ``key``, inner.

    ``_n`` is at least the number of ``rows`` with that key, and sums to at most ``n_rows``
    over the table, so fewer than ``HOT_SHARE`` keys are hot.
    """
    limit = n_rows // HOT_SHARE
    hot = F.broadcast(table.where(F.col("_n") > limit).drop("_n"))
    cold = table.where(F.col("_n") <= limit).drop("_n")
    few = rows.join(F.broadcast(table.where(F.col("_n") > limit).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(few.join(cold, key))


def _pointed(pairs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (v, u) with m, the least u that ``pairs`` (n rows) have for v."""
    least = materialize(pairs.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("_n")), "least")
    return join_counted(rows, least, "v", n)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (a, b) with b the least node of a's component, for every a but that least one.

    Large and small star steps in turn; each is a minimum by node, combined before the
    shuffle, and a join in which hot centres are broadcast.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(ordered.distinct(), "edges")
    seen = state(edges)
    while seen[0]:
        # Large star: larger neighbours of a node go to the least of its neighbours and itself.
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        moved = _pointed(both, both.where("u > v"), 2 * seen[0]).select(F.col("u").alias("a"), F.least("v", "m").alias("b"))
        large = materialize(moved.distinct(), "edges")
        # Small star: a node and its smaller neighbours go to the least of them.
        pairs = large.select(F.col("a").alias("v"), F.col("b").alias("u"))
        near = _pointed(pairs, pairs, large.count())
        small = near.select(F.col("u").alias("a"), F.col("m").alias("b")).union(near.select(F.col("v").alias("a"), F.col("m").alias("b")))
        edges = materialize(small.where("a <> b").distinct(), "edges")
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges
