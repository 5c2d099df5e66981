"""Discovery filters: which postings are relevant, junior and in reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirescope.config import Config
from hirescope.functions.text import blank_if_null, contains_any, first_contained, lookup, strip, text_or
from hirescope.fixed_values import COUNTRY_ALIASES


def lowered_title(title: Column) -> Column:
    return F.lower(blank_if_null(title))


def is_irrelevant(title: Column, cfg: Config) -> Column:
    return contains_any(lowered_title(title), cfg.irrelevant_words, cfg.word_boundaries)


def is_senior(title: Column, cfg: Config) -> Column:
    return contains_any(lowered_title(title), cfg.senior_words, cfg.word_boundaries)


def role_of(title: Column, cfg: Config) -> Column:
    """First enabled role category with a keyword in the title, else null."""
    enabled = {role: cfg.role_keywords.get(role, ()) for role in cfg.enabled_roles}
    if cfg.word_boundaries:
        return F.coalesce(
            *[F.when(contains_any(lowered_title(title), words, True), F.lit(role)) for role, words in enabled.items()]
        )
    return first_contained(lowered_title(title), enabled)


def is_entry(title: Column, level: Column, cfg: Config) -> Column:
    by_level = F.coalesce(F.lower(level).isin(*cfg.entry_levels), F.lit(False))
    return by_level | contains_any(lowered_title(title), cfg.entry_words, cfg.word_boundaries)


def in_reach(country: Column, cfg: Config) -> Column:
    """Remote or in a target location; a posting without a country is not."""
    place = F.lower(blank_if_null(country))
    if cfg.normalize_location_first:
        place = F.lower(
            F.coalesce(lookup(strip(place), COUNTRY_ALIASES), text_or(place, "Remote"))
        )
    return contains_any(place, cfg.remote_words) | contains_any(
        place, [t.lower() for t in cfg.target_locations]
    )


def filter_irrelevant(df: DataFrame, cfg: Config) -> DataFrame:
    return df.where(~is_irrelevant(F.col("title"), cfg))


def filter_senior(df: DataFrame, cfg: Config) -> DataFrame:
    return df.where(~is_senior(F.col("title"), cfg))


def classify_role(df: DataFrame, cfg: Config) -> DataFrame:
    return df.withColumn("role_category", role_of(F.col("title"), cfg))


def filter_entry_level(df: DataFrame, cfg: Config) -> DataFrame:
    """Keep relevant junior postings of an enabled role and stamp the role on them."""
    kept = filter_senior(filter_irrelevant(df, cfg), cfg)
    kept = classify_role(kept, cfg).where(F.col("role_category").isNotNull())
    return kept.where(is_entry(F.col("title"), F.col("experience_level"), cfg))


def filter_location(df: DataFrame, cfg: Config) -> DataFrame:
    return df.where(in_reach(F.col("country"), cfg))


def facet_filter(df: DataFrame, **facets: str | None) -> DataFrame:
    """Conjunction of equality tests; ``None`` or "All" leaves a facet open."""
    for column, wanted in facets.items():
        if wanted is not None and wanted != "All":
            df = df.where(F.col(column) == wanted)
    return df


def facet_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)
