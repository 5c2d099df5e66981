"""Field cleaning: from a raw posting to a posting ready for validation and storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirescope import fixed_values as fv
from hirescope.config import Config
from hirescope.functions.text import (
    FLAGS,
    SPACE,
    blank_if_null,
    contains_any,
    drop_tags,
    fingerprint,
    first_contained,
    lookup,
    strip,
    text_or,
)


def clean_title(title: Column) -> Column:
    """Drop a work-mode suffix after a dash and a trailing parenthesis."""
    suffix = f"{FLAGS}{SPACE}*[-–—]{SPACE}*({fv.TITLE_SUFFIX_WORDS}).*"
    parenthesis = rf"{FLAGS}{SPACE}*\(.*?\){SPACE}*$"
    cleaned = F.regexp_replace(strip(blank_if_null(title)), suffix, "")
    return strip(F.regexp_replace(cleaned, parenthesis, ""))


def normalize_title(title: Column) -> Column:
    """Lower-case and remove seniority words, one after the other, anywhere in the title."""
    result = strip(F.lower(title))
    for word in fv.TITLE_PREFIXES:
        result = F.replace(result, F.lit(word), F.lit(""))
    return strip(result)


def clean_company(company: Column) -> Column:
    pattern = "(?Ud)" + fv.COMPANY_SUFFIX.replace(r"\s", SPACE)
    return F.regexp_replace(strip(blank_if_null(company)), pattern, "")


def normalize_country(country: Column) -> Column:
    """Aliases resolved; missing means Remote; whitespace only stays empty."""
    stripped = strip(country)
    known = F.coalesce(lookup(F.lower(stripped), fv.COUNTRY_ALIASES), stripped)
    return F.when(blank_if_null(country) == "", F.lit("Remote")).otherwise(known)


def normalize_level(level: Column) -> Column:
    choices = (
        ("Entry-Level", ("entry", "junior", "graduate", "intern")),
        ("Mid-Level", ("mid", "intermediate")),
        ("Senior", ("senior", "sr", "lead")),
    )
    return F.coalesce(first_contained(F.lower(level), choices), F.lit("Entry-Level"))


def normalize_employment(employment: Column) -> Column:
    """First matching kind; null stays null so the caller can set the row aside."""
    choices = (
        ("full_time", ("full",)),
        ("part_time", ("part",)),
        ("contract", ("contract",)),
        ("internship", ("intern",)),
        ("graduate", ("graduate",)),
    )
    kind = F.coalesce(first_contained(F.lower(employment), choices), F.lit("unknown"))
    return F.when(employment.isNotNull(), kind)


def summarize(description: Column, max_length: int = 500) -> Column:
    text = drop_tags(blank_if_null(description))
    return F.when(F.length(text) <= max_length, text).otherwise(
        F.concat(F.substring(text, 1, max_length), F.lit("..."))
    )


def with_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "apply_url": text_or(F.col("apply_url"), F.col("url")),
            "description": blank_if_null(F.col("description")),
            "city": blank_if_null(F.col("city")),
        }
    )


def parse_postings(df: DataFrame, cfg: Config) -> DataFrame:
    """All field rules in one projection. Rows without an employment type are not parseable;
    :func:`unparseable` returns those."""
    title = clean_title(F.col("title"))
    return (
        with_defaults(df.where(F.col("employment_type").isNotNull()))
        .withColumns(
            {
                "title": title,
                "company": clean_company(F.col("company")),
                "description_summary": summarize(F.col("description"), cfg.summary_length),
                "country": normalize_country(F.col("country")),
                "experience_level": normalize_level(F.col("experience_level")),
                "employment_type": normalize_employment(F.col("employment_type")),
                "fingerprint": fingerprint(F.col("source"), F.col("external_id")),
            }
        )
        .withColumn("normalized_title", normalize_title(F.col("title")))
    )


def unparseable(df: DataFrame) -> DataFrame:
    return df.where(F.col("employment_type").isNull())


def backfill_role(stored: DataFrame, cfg: Config) -> DataFrame:
    """Stored postings with the role their title has today, and whether that changed."""
    from hirescope.operators.filters import role_of

    role = role_of(F.col("title"), cfg)
    changed = role.isNotNull() & ~F.col("role_category").eqNullSafe(role)
    return stored.withColumn("role_changed", changed).withColumn(
        "role_category", F.when(changed, role).otherwise(F.col("role_category"))
    )
