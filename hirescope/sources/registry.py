"""Registry of boards. A new board is one ``register(Source(...))`` call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirescope.config import Config


@dataclass(frozen=True)
class Source:
    """How one board's payload becomes postings.

    ``records`` splits a payload into an array of records; ``posting`` turns one
    record into a posting struct, or null when the record has to be dropped.
    ``context`` is what the crawler knew about the request (board, country code,
    search location).
    """

    name: str
    records: Callable[[Column], Column]
    posting: Callable[[Column, Column, Config], Column]


SOURCES: dict[str, Source] = {}


def register(source: Source) -> Source:
    SOURCES[source.name] = source
    return source


def one_record(ddl: str) -> Callable[[Column], Column]:
    """A payload that is a single JSON object. Malformed text parses to all nulls."""
    return lambda payload: F.array(F.from_json(payload, ddl))


def kept_if(condition: Column, posting: Column) -> Column:
    return F.when(condition, posting)
