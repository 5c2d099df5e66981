"""A stored index of keys: is a key known, without reading all that is stored.

A key is 16 bytes. An index part holds the keys of one attempt in pages of about
``PAGE_KEYS`` keys by hash, and a folder holds ``FOLDER_PAGES`` pages (a bucket): so a small batch is one file and
a large part many. A page has a Bloom filter of 4 KB. A lookup reads the filters of the buckets
that the asked keys fall into, and then only the buckets in which some filter says
yes, where keys are compared exactly. So a batch of new keys reads no stored key
but for false alarms (under 1 %).

``FAN_IN`` parts of a level are merged into one of the next: there are never more
than ``FAN_IN - 1`` parts per level (at most ``FAN_IN`` between a commit and its
merge), whatever the number of runs, and a key is rewritten once a level.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirescope.operators.versions import Attempt, Part, Snapshot, read_parts, snapshot
from hirescope.schemas import INT, STRING, struct
from hirescope.session import materialize

FOLDER_PAGES = 256
#: Bits of a page's filter: what one bitmap of Spark holds. Four bits a key fill about a quarter of it.
PAGE_BITS = 32768
PAGE_KEYS = 2500
HASHES = 4
FAN_IN = 8
_KEYS = struct(bucket=INT, page=INT, key=T.BinaryType(), of_run=STRING, attempt=STRING)
_FILTERS = struct(bucket=INT, page=INT, bits=T.BinaryType(), attempt=STRING)


def key_of(*columns: Column) -> Column:
    """16 bytes for some texts; nulls are empty. Lengths keep neighbours apart."""
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("|", *[F.length(t).cast("string") for t in texts], *texts).cast("binary")))


def _hashed(salt: int, size) -> Column:
    size = size if isinstance(size, Column) else F.lit(size)
    return F.pmod(F.xxhash64(F.lit(salt), "key"), size).cast("int")


def _places() -> Column:
    return F.array(*[_hashed(2 + i, PAGE_BITS) for i in range(HASHES)])


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1


def _bucket(page: Column) -> Column:
    return F.floor(page / FOLDER_PAGES).cast("int")


def add(attempt: Attempt, name: str, keys: DataFrame, level: int = 0) -> None:
    """Write ``keys`` (key, of_run), each once, as a part of the index and the filters of that part."""
    n = keys.count()
    if not n:
        return
    pages = math.ceil(n / PAGE_KEYS)
    page = _hashed(1, pages)
    rows = keys.select(_bucket(page).alias("bucket"), page.alias("page"), "key", "of_run")
    # A bucket is sorted by page, so row groups can be skipped.
    sorted_ = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "page")
    written = attempt.write(sorted_, name, "bucket", level=level, pages=pages)
    marks = written.select("bucket", "page", F.explode(_places()).alias("place"))
    filters = marks.groupBy("bucket", "page").agg(F.bitmap_construct_agg("place").alias("bits"))
    attempt.write(filters.hint("rebalance", "bucket"), f"{name}_filters", "bucket", level=level, pages=pages)


def _buckets_of(rows: DataFrame) -> list[tuple[str, int]]:
    """(attempt, bucket) of some rows: at most as many as there are folders."""
    return [(r["attempt"], r["bucket"]) for r in rows.select("attempt", "bucket").distinct().collect()]


def candidates(spark: SparkSession, root: str, parts: list[Part], name: str, keys: DataFrame) -> DataFrame:
    """(key, bucket, attempt): where a filter does not rule a key out. Reads filters of the keys' buckets only."""
    sizes = F.array(*[F.struct(F.lit(p.attempt).alias("attempt"), F.lit(p.pages).alias("pages")) for p in parts])
    asked = keys.withColumn("_part", F.explode(sizes)).select("key", F.col("_part.attempt").alias("attempt"), _hashed(1, F.col("_part.pages")).alias("page"))
    asked = asked.withColumn("bucket", _bucket(F.col("page")))
    small = all(p.pages <= FOLDER_PAGES for p in parts)  # one folder each
    places = [(p.attempt, 0) for p in parts] if small else _buckets_of(asked)
    stored = in_buckets(spark, root, f"{name}_filters", _FILTERS, parts, places)
    tested = reduce(Column.__and__, [_is_set(F.col("bits"), _hashed(2 + i, PAGE_BITS)) for i in range(HASHES)])
    return asked.join(stored, ["attempt", "bucket", "page"]).where(tested).select("key", "bucket", "attempt")


def in_buckets(spark: SparkSession, root: str, table: str, schema: T.StructType, parts: list[Part],
               places: list[tuple[str, int]]) -> DataFrame:
    """Rows of some buckets of some parts of a table; other folders are pruned."""
    by_part: dict[str, list[int]] = {}
    for attempt, bucket in places:
        by_part.setdefault(attempt, []).append(bucket)
    rows = read_parts(spark, root, [Part(table, p.run_id, p.attempt) for p in parts if p.attempt in by_part], schema)
    any_of = [(F.col("attempt") == a) & F.col("bucket").isin(sorted(b)) for a, b in by_part.items()]
    return rows.where(reduce(Column.__or__, any_of, F.lit(False)))


def known(spark: SparkSession, root: str, now: Snapshot, name: str, keys: DataFrame, skip_run: str | None = None) -> DataFrame:
    """Those of ``keys`` (key) that the index holds for another run than ``skip_run``."""
    parts = now.of(name)
    if not parts:
        return keys.where("false")
    found = materialize(candidates(spark, root, parts, name, keys), "key-candidates")
    places = _buckets_of(found)
    if not places:
        return keys.where("false")
    stored = in_buckets(spark, root, name, _KEYS, parts, places)
    if skip_run is not None:
        stored = stored.where(F.col("of_run") != skip_run)
    return found.join(stored, ["attempt", "bucket", "key"], "left_semi").select("key").distinct()


def forget(attempt: Attempt, name: str, run_id: str) -> None:
    """Take a run's keys out: its own part goes, and merged parts that hold some are written anew."""
    own = [p for p in attempt.base.of(name) if p.run_id == run_id]
    for part in own:
        _remove(attempt, name, part)
    if own:
        return
    for part in attempt.base.of(name):
        rows = read_parts(attempt.spark, attempt.root, [part], _KEYS)
        if part.level and not rows.where(F.col("of_run") == run_id).isEmpty():
            left = Attempt(attempt.spark, attempt.root, f"merged-{uuid.uuid4().hex[:12]}", "forget", attempt.base)
            add(left, name, rows.where(F.col("of_run") != run_id).select("key", "of_run"), part.level)
            attempt.added += left.added
            _remove(attempt, name, part)


def _remove(attempt: Attempt, name: str, part: Part) -> None:
    attempt.removed += [p for p in attempt.base.parts if p.attempt == part.attempt and p.table in (name, f"{name}_filters")]


def merge(spark: SparkSession, root: str, name: str, now: Snapshot | None = None) -> Snapshot:
    """Merge parts while a level has ``FAN_IN`` of them, a version each; the last version. ``now`` is the latest, if known."""
    now = now or snapshot(spark, root)
    while True:
        levels: dict[int, list[Part]] = {}
        for part in now.of(name):
            levels.setdefault(part.level, []).append(part)
        full = [level for level, parts in sorted(levels.items()) if len(parts) >= FAN_IN]
        if not full:
            return now
        attempt = Attempt(spark, root, f"merged-{uuid.uuid4().hex[:12]}", f"merge {name}", now)
        rows = read_parts(spark, root, levels[full[0]], _KEYS).select("key", "of_run")
        add(attempt, name, rows, full[0] + 1)
        for part in levels[full[0]]:
            _remove(attempt, name, part)
        now = attempt.commit()
