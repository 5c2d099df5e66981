"""Landing folder -> stored postings, batch after batch, nothing stored twice."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hirescope.config import Config
from hirescope.operators import key_index
from hirescope.operators.lookups import store_key
from hirescope.operators.normalize import parse_postings
from hirescope.operators.store import store_run
from hirescope.operators.validate import accepted, validate_postings
from hirescope.operators.versions import read_parts
from hirescope.plans.discovery import discover
from hirescope.plans.rejects import rejects
from hirescope.plans.run import check_landed, log, with_skills
from hirescope.schemas import LANDING, TIME, struct
from hirescope.session import materialize
from hirescope.sources import map_landing, unreadable_payloads, written_by_board
from hirescope.streaming import logs


def read_landing(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LANDING)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def process_batch(raw: DataFrame, cfg: Config) -> DataFrame:
    """One batch of raw postings as validated postings: the same steps as a full run."""
    return validate_postings(parse_postings(discover(raw, cfg), cfg), cfg)


def ingest(landing: DataFrame, root: str, checkpoint: str, cfg: Config, extractor=None) -> StreamingQuery:
    """Write new valid postings, their companies and, with an ``extractor``, their skills under ``root``,
    all others to the table ``rejects``, and a row per batch to the run log.

    A batch is parsed once. Every batch is a run of its number. One that is repeated
    after a failure writes a new attempt in place of the old one and compares itself with the other
    batches only, so the result is the same as if it had run once.
    """
    spark = landing.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        started = datetime.now(timezone.utc)
        mapped = materialize(map_landing(written_by_board(batch), cfg), "stream-mapped")
        found, checked, counts = check_landed(mapped, cfg)
        good = accepted(checked)
        if extractor:
            good = materialize(with_skills(good, cfg, extractor), "stream-postings")
        store_run(good, root, str(batch_id), cfg, rejects(unreadable_payloads(mapped), found, checked))
        log(spark, root, str(batch_id), started, "completed", counts, {})

    return (
        landing.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_postings(rejects: DataFrame) -> DataFrame:
    """Rejected postings that were too old when they arrived."""
    return rejects.where(F.array_contains("reasons", "too_old"))


def dedup_stream(postings: DataFrame, event_time: str, horizon: str, cfg: Config) -> DataFrame:
    """First arrival per key within the horizon; the state of older keys is dropped, and rows behind the
    horizon are too: :func:`dedup_to` keeps them."""
    return postings.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(store_key(cfg))


SEEN = struct(day=T.DateType(), key=T.BinaryType(), at=TIME)


def dedup_to(postings: DataFrame, event_time: str, horizon: str, cfg: Config, root: str, checkpoint: str) -> StreamingQuery:
    """First posting per key, with an output for every row: tables ``unique``, ``repeats`` and ``late`` of the
    store ``root`` hold all rows of the input between them.

    The horizon lies ``horizon`` before the latest event time of earlier batches. Rows before it are late.
    A key is known while the row that was kept for it is not behind the horizon; of a batch the earliest
    row by event time, then by content, is kept. What was kept is a log by day of event time:
    a batch reads the days from the horizon on, whose folders are all it lists.
    """
    spark = postings.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        attempt, seen = logs.begin(spark, root, batch_id)
        if attempt is None:
            return
        at = F.col(event_time).cast("timestamp")
        order = F.struct(at.alias("at"), F.xxhash64(*batch.columns).alias("hash"), F.col("_row").alias("row"))
        key = key_index.key_of(*[F.col(c) for c in store_key(cfg)])
        rows = materialize(batch.withColumns({"_key": key, "_row": F.monotonically_increasing_id()}), "arrivals")
        edge = F.lit(None).cast("timestamp") if seen is None else F.lit(seen) - F.expr(f"INTERVAL {horizon}")
        is_late = F.coalesce(at < edge, F.lit(False))
        firsts = materialize(rows.where(~is_late).groupBy("_key").agg(F.min(order).alias("first")), "firsts")
        parts = attempt.base.of("seen")
        if parts:
            known = read_parts(spark, root, parts, SEEN).where((F.col("day") >= F.to_date(edge)) & (F.col("at") >= edge))
            firsts = materialize(firsts.join(known.select(F.col("key").alias("_key")), "_key", "left_anti"), "new-firsts")
        kept = firsts.select(F.col("first.row").alias("_row"))
        plain = lambda df: df.drop("_key", "_row")
        attempt.write(plain(rows.where(is_late)), "late")
        attempt.write(plain(rows.join(kept, "_row", "left_semi")), "unique")
        attempt.write(plain(rows.where(~is_late).join(kept, "_row", "left_anti")), "repeats")
        days = firsts.select(F.to_date("first.at").alias("day"), F.col("_key").alias("key"), F.col("first.at").alias("at"))
        attempt.write(days.hint("rebalance", "day"), "seen", "day")
        now = logs.finish(attempt, batch_id, rows, event_time)
        logs.merge(spark, root, "seen", SEEN, lambda df: df, "day", now=now)

    return (
        postings.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
