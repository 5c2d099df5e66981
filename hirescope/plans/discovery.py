"""Discovery: postings of all boards -> relevant junior postings in reach, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirescope.config import Config
from hirescope.operators.dedup import dedup_postings
from hirescope.operators.filters import filter_entry_level, filter_location, in_reach
from hirescope.session import materialize


def discover(raw: DataFrame, cfg: Config, written: bool = False) -> DataFrame:
    """Filters, then de-duplication, then location.

    What passes the filters is written once, unless ``raw`` is a ``written`` table itself: de-duplication
    reads it for its keys and again for the rows it keeps, and landed payloads are parsed only for the first.

    The location filter must see the de-duplicated rows: a kept posting out of
    reach still hides its later copies. It is a row filter, so Spark applies it
    before the final join on the wide rows.
    """
    junior = filter_entry_level(raw, cfg)
    return filter_location(dedup_postings(junior if written else materialize(junior, "entry-level")), cfg)


def discovery_funnel(raw: DataFrame, cfg: Config) -> DataFrame:
    """Counts after each step, as one row."""
    junior = filter_entry_level(raw, cfg).select(
        "source", "external_id", "title", "company", "country", "ingest_seq"
    )
    junior = materialize(junior, "funnel")  # slim, read by the steps below
    unique = dedup_postings(junior)
    reach = unique.agg(
        F.count(F.lit(1)).alias("n_unique"), F.count_if(in_reach(F.col("country"), cfg)).alias("n_located")
    )
    raw_count = raw.agg(F.count(F.lit(1)).alias("n")).scalar()
    junior_count = junior.agg(F.count(F.lit(1)).alias("n")).scalar()
    return reach.select(
        raw_count.alias("n_raw"), junior_count.alias("n_entry_level"), "n_unique", "n_located"
    )
