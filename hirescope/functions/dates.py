"""Date parsing. ISO text without an offset means UTC; the session zone must be UTC."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full dates only: Spark's own cast would also take a bare year or year-month.
_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"
)


def as_timestamp(moment: datetime) -> Column:
    """A literal timestamp; naive datetimes are UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    delta = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    micros = (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
    return F.timestamp_micros(F.lit(micros))


def parse_iso(text: Column) -> Column:
    """ISO-8601 date or date-time, trailing Z or offset allowed; anything else is null."""
    tidy = F.regexp_replace(text, ",", ".")
    tidy = F.regexp_replace(tidy, r"([T ]\d{2})($|[Z+-])", "$1:00$2")
    tidy = F.regexp_replace(tidy, r"(:\d{2}(?:\.\d+)?[+-]\d{2})(\d{2})$", "$1:$2")
    tidy = F.regexp_replace(tidy, r"(:\d{2}(?:\.\d+)?[+-]\d{2})$", "$1:00")
    return F.when(text.rlike(_ISO), F.try_to_timestamp(tidy))


def parse_relative(text: Column, as_of: Column) -> Column:
    """"3 days ago" -> ``as_of`` minus 3 days. A number without a unit is now; no number is null."""
    lowered = F.lower(text)
    amount = F.regexp_extract(lowered, r"(\d+)", 1).try_cast("bigint")
    seconds = (
        F.when(lowered.contains("minute"), F.lit(60))
        .when(lowered.contains("hour"), F.lit(3_600))
        .when(lowered.contains("day"), F.lit(86_400))
        .when(lowered.contains("week"), F.lit(604_800))
        .otherwise(F.lit(0))
    )
    return F.timestamp_micros(
        F.unix_micros(as_of) - F.try_multiply(amount, seconds.cast("bigint") * F.lit(1_000_000))
    )
