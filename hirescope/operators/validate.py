"""Validation scores and the accept/reject verdict."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirescope.config import Config
from hirescope.functions.dates import as_timestamp
from hirescope.functions.numbers import round_even
from hirescope.functions.text import blank_if_null, count_contained, mentions_any


def _joined(first: str, second: str) -> Column:
    return F.lower(F.concat_ws(" ", blank_if_null(F.col(first)), blank_if_null(F.col(second))))


def scam_score(cfg: Config) -> Column:
    hits = count_contained(_joined("title", "description"), cfg.scam_phrases)
    return F.least(hits * F.lit(0.3), F.lit(1.0))


def url_score(url: Column) -> Column:
    return (
        F.when(blank_if_null(url) == "", 0.0)
        .when(~(url.startswith("http://") | url.startswith("https://")), 0.1)
        .when(F.length(url) < 10, 0.2)
        .otherwise(1.0)
    )


def freshness_score(posting_date: Column, cfg: Config) -> Column:
    """1.0 up to ``max_age_days`` whole elapsed days, 0.5 up to twice that, then 0.1; unknown 0.5.

    "At most d whole days" means "less than d + 1 days ago", so the test is a
    plain comparison with a constant and can reach the file scan.
    """

    def newer_than(days: int) -> Column:
        return posting_date > as_timestamp(cfg.as_of - timedelta(days=days + 1))

    return (
        F.when(posting_date.isNull(), 0.5)
        .when(newer_than(cfg.max_age_days), 1.0)
        .when(newer_than(cfg.max_age_days * 2), 0.5)
        .otherwise(0.1)
    )


def completeness() -> Column:
    def present(names: tuple[str, ...]) -> Column:
        flags = [
            (F.col(c).isNotNull() & (F.col(c).cast("string") != "")).cast("int") for c in names
        ]
        return sum(flags, F.lit(0)) / F.lit(float(len(names)))

    required = present(("title", "company", "url"))
    optional = present(("country", "description", "posting_date", "experience_level"))
    return required * F.lit(0.7) + optional * F.lit(0.3)


def staffing_flag(cfg: Config) -> Column:
    return mentions_any(_joined("company", "description"), cfg.staffing_phrases)


def score_postings(df: DataFrame, cfg: Config) -> DataFrame:
    """The five component scores as columns."""
    return df.withColumns(
        {
            "scam_score": scam_score(cfg),
            "url_score": url_score(F.col("url")),
            "freshness_score": freshness_score(F.col("posting_date"), cfg),
            "completeness": completeness(),
            "is_staffing": staffing_flag(cfg),
        }
    )


def validate_postings(df: DataFrame, cfg: Config) -> DataFrame:
    """Adds ``is_valid``, ``validation_score`` and ``reasons``.

    Valid means no reason at all: the score is 1.0 then, so its own limit of 0.5
    never decides. ``is_valid`` names each component once, because Spark copies a
    filter's expressions down to the scan and would repeat the work otherwise.
    """
    scam, url = F.col("scam_score"), F.col("url_score")
    fresh, complete = F.col("freshness_score"), F.col("completeness")
    checks = (
        ("scam_indicators", scam > 0.5, -scam),
        ("invalid_url", url < 0.3, url - F.lit(0.3)),
        ("too_old", fresh < 0.3, fresh - F.lit(0.3)),
        ("incomplete_data", complete < 0.5, complete - F.lit(0.5)),
        ("staffing_agency", F.col("is_staffing"), F.lit(-0.3)),
    )
    score = F.lit(1.0)
    for _, failed, change in checks:
        score = score + F.when(failed, change).otherwise(0.0)
    spotless = reduce(and_, [~failed for _, failed, _ in checks])
    reasons = F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed, _ in checks]))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    components = ("scam_score", "url_score", "freshness_score", "completeness", "is_staffing")
    return (
        score_postings(df, cfg)
        .withColumns({"reasons": reasons, "validation_score": round_even(clamped, 3), "is_valid": spotless})
        .drop(*components)
    )


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where("is_valid").drop("is_valid", "reasons")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where("NOT is_valid").select("ingest_seq", "title", "reasons")


def rejection_report(validated: DataFrame) -> DataFrame:
    """How many postings each reason hit; a posting can count under several."""
    return (
        validated.select(F.explode_outer("reasons").alias("reason"))
        .where(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )
