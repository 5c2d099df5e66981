"""Numbers found in text, and half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def salary_range(text: Column) -> Column:
    """Struct (salary_min, salary_max, salary_currency) from free salary text.

    Thousands commas are dropped and the first two digit runs are taken as they
    stand ("$60k" gives 60). Without any number all three fields are null.
    """
    runs = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"(?U)\d+"), F.lit(0))
    low, high = F.get(runs, F.lit(0)), F.get(runs, F.lit(1))
    currency = (
        F.when(text.contains("$") | text.contains("USD"), "USD")
        .when(text.contains("€") | text.contains("EUR"), "EUR")
        .when(text.contains("£") | text.contains("GBP"), "GBP")
        .otherwise("USD")
    )
    return F.struct(
        low.try_cast("int").alias("salary_min"),
        high.try_cast("int").alias("salary_max"),
        F.when(low.isNotNull(), currency).alias("salary_currency"),
    )


def whole_number(text: Column) -> Column:
    """Number text to INT, fraction cut off; null if it is no number."""
    return F.coalesce(text.try_cast("int"), text.try_cast("double").try_cast("int"))
