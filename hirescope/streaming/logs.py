"""Running results as a log of parts, merged by levels.

Every micro-batch adds a part to a table of a versioned store
(:mod:`hirescope.operators.versions`). Where a level has ``FAN_IN`` parts they are merged into one of the
next, by whatever joins two parts of this log into one (the last value per key, or a
sum). So a reader opens less than ``FAN_IN`` parts a level, however many batches
there were, and a value is written once per level.

A table ``clock`` of one row holds the last batch applied and the latest event time seen: a
batch that is repeated after its commit changes nothing, and what is late is measured
by what earlier batches brought.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirescope.operators.versions import Attempt, Part, Snapshot, read_parts, snapshot
from hirescope.schemas import LONG, TIME, struct

FAN_IN = 8
CLOCK = struct(batch=LONG, seen=TIME)


def live(spark: SparkSession, root: str, table: str, schema: T.StructType) -> DataFrame:
    """All live rows of a log."""
    return read_parts(spark, root, snapshot(spark, root).of(table), schema)


def merge(spark: SparkSession, root: str, table: str, schema: T.StructType, merged: Callable[[DataFrame], DataFrame],
          *partitions: str, now: Snapshot | None = None) -> Snapshot:
    """Merge parts while a level has ``FAN_IN`` of them, a version each; the last version. ``now`` is the latest, if known."""
    now = now or snapshot(spark, root)
    while True:
        levels: dict[int, list[Part]] = {}
        for part in now.of(table):
            levels.setdefault(part.level, []).append(part)
        full = next((level for level, parts in sorted(levels.items()) if len(parts) >= FAN_IN), None)
        if full is None:
            return now
        attempt = Attempt(spark, root, f"merged-{uuid.uuid4().hex[:12]}", f"merge {table}", now)
        attempt.removed = levels[full]
        attempt.write(merged(read_parts(spark, root, levels[full], schema)).hint("rebalance", *partitions), table, *partitions, level=full + 1)
        now = attempt.commit()


def begin(spark: SparkSession, root: str, batch_id: int) -> tuple[Attempt | None, datetime | None]:
    """The attempt of a batch and the latest event time of earlier ones; no attempt if the batch is applied already."""
    attempt = Attempt(spark, root, f"batch-{batch_id}", "batch")
    clock = read_parts(spark, root, attempt.base.of("clock"), CLOCK).first()
    if clock and clock["batch"] >= batch_id:
        return None, clock["seen"]
    return attempt, clock["seen"] if clock else None


def finish(attempt: Attempt, batch_id: int, batch: DataFrame, event_time: str) -> Snapshot:
    """Commit the batch with its clock."""
    before = read_parts(attempt.spark, attempt.root, attempt.base.of("clock"), CLOCK).select("seen")
    seen = batch.select(F.col(event_time).cast("timestamp").alias("seen")).union(before).agg(F.max("seen").alias("seen"))
    attempt.removed += attempt.base.of("clock")
    attempt.write(seen.select(F.lit(batch_id).cast("long").alias("batch"), "seen"), "clock")
    return attempt.commit()
