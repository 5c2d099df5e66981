"""Running counts: postings per time window and role, postings per skill.

Results are kept as a log of updates and read as the last update per key, or as a log
of additions and read as their sum. Windows that are still open are visible. A
log is merged by levels (:mod:`hirescope.streaming.logs`), so it is read in a bounded
number of parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hirescope.config import Config
from hirescope.operators.filters import classify_role
from hirescope.operators.skills import explode_names, extract_skill_names
from hirescope.operators.versions import Attempt, snapshot
from hirescope.schemas import LONG, STRING, TIME, struct
from hirescope.session import materialize
from hirescope.streaming import logs

WINDOWS = struct(window_start=TIME, window_end=TIME, role_category=STRING, n=LONG)


def _window(length: str, slide: str | None):
    return F.window("posting_date", length, slide) if slide else F.window("posting_date", length)


def _counted(dated: DataFrame, length: str, slide: str | None) -> DataFrame:
    return (
        dated.groupBy(_window(length, slide).alias("w"), "role_category")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "role_category", "n")
    )


def windowed_counts(postings: DataFrame, cfg: Config, length: str, slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """Postings per window of ``posting_date`` and role.

    Every row counts, however late: the state is one number per window and role,
    a few hundred a year. A ``lateness`` drops windows from the state once they
    are that old, and with them rows that come later still; :func:`count_windows` keeps those.
    """
    dated = classify_role(postings, cfg).where(F.col("posting_date").isNotNull())
    return _counted(dated.withWatermark("posting_date", lateness) if lateness else dated, length, slide)


def count_windows(postings: DataFrame, cfg: Config, length: str, slide: str | None, lateness: str, root: str,
                  checkpoint: str) -> StreamingQuery:
    """Windowed counts with a second output: rows dated more than ``lateness`` before the latest date of
    earlier batches go to the table ``late``, whole; all others are counted in ``additions``.

    There is no state but the log of additions, so none is ever dropped: rows counted and late
    rows are all dated rows.
    """
    spark = postings.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        attempt, seen = logs.begin(spark, root, batch_id)
        if attempt is None:
            return
        dated = materialize(classify_role(batch, cfg).where(F.col("posting_date").isNotNull()), "dated")
        is_late = F.lit(False) if seen is None else F.coalesce(F.col("posting_date") < F.lit(seen) - F.expr(f"INTERVAL {lateness}"), F.lit(False))
        attempt.write(_counted(dated.where(~is_late), length, slide), "additions")
        attempt.write(dated.where(is_late), "late")
        now = logs.finish(attempt, batch_id, dated, "posting_date")
        logs.merge(spark, root, "additions", WINDOWS, summed, now=now)

    return (
        postings.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def summed(additions: DataFrame) -> DataFrame:
    keys = [c for c in additions.columns if c != "n"]
    return additions.groupBy(*keys).agg(F.sum("n").alias("n"))


def counted_windows(spark: SparkSession, root: str) -> DataFrame:
    return summed(logs.live(spark, root, "additions", WINDOWS))


def skill_counts(postings: DataFrame, cfg: Config) -> DataFrame:
    """Postings per skill; the state has one row per term of the taxonomy."""
    names = explode_names(extract_skill_names(postings, cfg))
    return names.groupBy("skill").agg(F.count(F.lit(1)).alias("n"))


def write_updates(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Log every changed count; a repeated batch replaces what it logged, and the last batch of a key counts."""
    spark = counts.sparkSession
    logged = _logged(counts.schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        attempt = Attempt(spark, path, f"batch-{batch_id}", "batch")
        attempt.removed = attempt.base.of("updates", attempt.run_id)
        attempt.write(batch.withColumn("batch", F.lit(batch_id).cast("long")), "updates")
        logs.merge(spark, path, "updates", logged, _last, now=attempt.commit())

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _logged(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.LongType())])


def _last(updates: DataFrame) -> DataFrame:
    keys = [c for c in updates.columns if c not in ("n", "batch")]
    return updates.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"), F.max("batch").alias("batch"))


def latest_counts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The last logged count per key, from the live parts of the log."""
    return _last(logs.live(spark, path, "updates", _logged(schema))).drop("batch")


def log_parts(spark: SparkSession, path: str) -> int:
    """How many folders a reader of the log opens."""
    return len(snapshot(spark, path).parts)
