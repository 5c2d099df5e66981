"""Board payloads to canonical postings. Importing the package registers every board."""

from hirescope.sources import cards, json_boards  # noqa: F401  (registration)
from hirescope.sources.registry import SOURCES, Source, register
from hirescope.sources.union import (
    dedup_and_cap,
    map_landing,
    map_source,
    quarantined,
    union_sources,
    unreadable_payloads,
    usable_postings,
    written_by_board,
)

__all__ = [
    "SOURCES", "Source", "register", "map_source", "union_sources", "quarantined", "dedup_and_cap",
    "map_landing", "usable_postings", "unreadable_payloads", "written_by_board",
]
