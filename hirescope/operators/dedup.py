"""De-duplication: the greedy two-key rule, the company dimension, case-insensitive terms."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirescope.functions.graph import components, join_counted
from hirescope.functions.stats import first_value
from hirescope.functions.text import blank_if_null, fingerprint, strip
from hirescope.session import keep_listed, materialize

#: Rounds over all rows before conflict components are looked at, and rows of a component that one task walks.
PLAIN_ROUNDS = 4
LARGEST_WALK = 100_000


def title_company_key():
    return F.unhex(
        F.md5(
            F.concat_ws(
                ":",
                strip(F.lower(blank_if_null(F.col("title")))),
                strip(F.lower(blank_if_null(F.col("company")))),
            )
        )
    )


def _round(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that come first in both of their groups, and those that are left: without a key of such a row."""
    # Group minima come from aggregates that combine before the shuffle; they
    # meet on seq, which is unique, so no hot key is joined here.
    first_k = live.groupBy("k").agg(F.min("seq").alias("seq"))
    first_f = live.groupBy("f").agg(F.min("seq").alias("seq"))
    kept = materialize(first_k.join(first_f, "seq"), "dedup-kept")
    # A key's kept row is one row: a hot key makes only the left side of these
    # joins uneven, and that side Spark can split.
    rest = live.join(kept.select("k"), "k", "left_anti").join(kept.select("f"), "f", "left_anti")
    return kept.select("seq"), materialize(rest, "dedup-rest")


def _walked(rows: pd.DataFrame) -> pd.DataFrame:
    """One conflict component in arrival order."""
    seen_k, seen_f, kept = set(), set(), []
    for k, f, seq in rows.sort_values("seq")[["k", "f", "seq"]].itertuples(index=False):
        if k not in seen_k and f not in seen_f:
            seen_k.add(k)
            seen_f.add(f)
            kept.append(seq)
    return pd.DataFrame({"seq": kept})


def _by_component(live: DataFrame, largest: int) -> tuple[DataFrame, DataFrame]:
    """``seq`` kept of all components of up to ``largest`` rows that share keys, and the rows of larger ones.

    Keys are nodes by a 64-bit hash; should two of them fall together, a component is larger and the result the same.
    """
    nodes = live.withColumns({"a": F.xxhash64("k", F.lit(0)), "b": F.xxhash64("f", F.lit(1))})
    roots = components(nodes.select("a", "b"))
    placed = materialize(nodes.join(roots.select("a", F.col("b").alias("root")), "a", "left").select(
        "k", "f", "seq", F.coalesce("root", "a").alias("component")), "dedup-components")
    sizes = materialize(placed.groupBy("component").agg(F.count(F.lit(1)).alias("_n")), "component-sizes")
    sized = join_counted(placed, sizes.withColumn("rows", F.col("_n")), "component", placed.count())
    seq = T.StructType([T.StructField("seq", live.schema["seq"].dataType)])
    kept = sized.where(F.col("rows") <= largest).select("component", "k", "f", "seq").groupBy("component").applyInPandas(_walked, seq)
    return materialize(kept, "dedup-kept"), materialize(sized.where(F.col("rows") > largest).select("k", "f", "seq"), "dedup-rest")


def greedy_kept(edges: DataFrame, plain_rounds: int = PLAIN_ROUNDS, largest: int = LARGEST_WALK) -> DataFrame:
    """``seq`` of the rows that a pass in arrival order would keep.

    ``edges`` has ``k``, ``f`` (binary keys) and ``seq`` (unique). A row is kept
    iff no row kept before it shares its ``k`` or its ``f``.

    Each round keeps every row that comes first in both of its groups and drops
    the rows that share a key with one of those; both are certain, so repeating
    until no row is left gives the exact result, at every size. Only these three
    slim columns move. Rows that wait for one another in turn (a chain of shared
    keys in arrival order) take a round each. So what ``plain_rounds`` leave, which is
    little, is split into components of rows that share keys: each of up to ``largest`` rows is
    walked in arrival order by itself, and rounds go on in larger ones only.
    """
    # Of rows equal in both keys only the first can be kept.
    live = materialize(edges.groupBy("k", "f").agg(F.min("seq").alias("seq")), "dedup-edges")
    parts: list[DataFrame] = []
    while True:
        kept, live = _by_component(live, largest) if len(parts) == plain_rounds else _round(live)
        parts.append(kept)
        if live.isEmpty():
            return reduce(DataFrame.unionByName, parts)


def dedup_postings(df: DataFrame) -> DataFrame:
    """Keep a posting iff neither its title + company nor its fingerprint was kept before."""
    edges = df.select(
        title_company_key().alias("k"),
        F.unhex(fingerprint(F.col("source"), F.col("external_id"))).alias("f"),
        F.col("ingest_seq").alias("seq"),
    )
    kept = greedy_kept(edges).withColumnRenamed("seq", "ingest_seq")
    return keep_listed(df, kept, "ingest_seq", "dedup-kept-numbers")


def company_upsert(postings: DataFrame, stored: DataFrame) -> DataFrame:
    """The company dimension after adding the companies of new postings.

    The first spelling of a name wins; stored spellings stay; postings without a
    company add nothing.
    """
    named = postings.where(blank_if_null(F.col("company")) != "").select(
        strip(F.lower(F.col("company"))).alias("normalized_name"),
        F.col("company").alias("name"),
        F.col("ingest_seq").alias("first_seq"),
    )
    new = first_value(named, "normalized_name", "name", "first_seq").join(
        stored.select("normalized_name"), "normalized_name", "left_anti"
    )
    return stored.select("normalized_name", "name", "first_seq").unionByName(new)


def distinct_terms(df: DataFrame, term: str, order: str) -> DataFrame:
    """First spelling per case-insensitive term, in order of first appearance."""
    keyed = df.select(F.lower(F.col(term)).alias("_key"), term, order)
    return first_value(keyed, "_key", term, order).drop("_key")
