"""Stored tables: new postings and companies, the run log, additive schema changes.

A table is a folder of Parquet parts, one per run and attempt; what is readable is
told by the store's versions (:mod:`hirescope.operators.versions`). A run that is
repeated writes a new attempt, and one commit puts all its tables in place of those of
the earlier attempt: postings, companies, skills and rejects change together or not
at all, and a run or backfill that stops half way changes nothing. Which postings
and companies are new is asked of key indexes (:mod:`hirescope.operators.key_index`),
so that a batch does not read what earlier ones stored.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirescope.config import Config
from hirescope.functions.stats import first_value
from hirescope.functions.text import blank_if_null, strip
from hirescope.operators import key_index
from hirescope.operators.lookups import new_postings, store_key
from hirescope.operators.normalize import backfill_role
from hirescope.operators.skills import explode_hits
from hirescope.operators.versions import Attempt, read_parts, snapshot
from hirescope.schemas import ARRIVAL, RUN_LOG, struct
from hirescope.session import keep_listed, materialize

#: What a run writes; ``recommendations`` comes with its matches.
RUN_TABLES = ("jobs", "companies", "job_skills", "skills", "rejects", "late")
COMPANY_KEYS = "company_keys"


def company_key() -> Column:
    """Lower-cased, stripped name; null without a name. It is the company's id in every table."""
    return F.nullif(strip(F.lower(blank_if_null(F.col("company")))), F.lit(""))


def posting_keys(cfg: Config) -> str:
    """Name of the index of stored postings: the store's key is a setting."""
    return "posting_keys" if len(store_key(cfg)) > 1 else "posting_keys_by_id"


def _posting_key(cfg: Config) -> Column:
    return key_index.key_of(*[F.col(c) for c in store_key(cfg)])


def _flagged(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "company_id": company_key(),
            "posting_month": F.coalesce(F.date_format("posting_date", "yyyy-MM"), F.lit("unknown")),
            "is_validated": F.lit(True),
            "is_active": F.lit(True),
            "is_duplicate": F.lit(False),
        }
    )


def store_rows(batch: DataFrame, stored_jobs: DataFrame, cfg: Config) -> DataFrame:
    """The rows a run adds to the jobs table, with the company's id and flags set."""
    return _flagged(new_postings(batch, stored_jobs, cfg))


def _not_known(attempt: Attempt, name: str, firsts: DataFrame) -> DataFrame:
    """Rows of ``firsts`` (key, one row each) whose key no other run has stored."""
    known = key_index.known(attempt.spark, attempt.root, attempt.base, name, firsts.select("key"), attempt.run_id)
    return firsts.join(known, "key", "left_anti")


def index_missing_runs(attempt: Attempt, cfg: Config) -> None:
    """Index postings of runs that were stored under another key setting, so that the index knows all of ``jobs``."""
    name = posting_keys(cfg)
    if attempt.base.of(name) or not attempt.base.of("jobs"):
        return
    columns = struct(**{c: T.StringType() for c in store_key(cfg)}, run_id=T.StringType())
    rows = read_parts(attempt.spark, attempt.root, attempt.base.of("jobs"), columns)
    catch_up = Attempt(attempt.spark, attempt.root, f"merged-{attempt.id}", f"index {name}", attempt.base)
    keys = rows.select(_posting_key(cfg).alias("key"), F.col("run_id").alias("of_run")).groupBy("key").agg(F.min("of_run").alias("of_run"))
    key_index.add(catch_up, name, materialize(keys, "keys"), level=1)
    attempt.base = catch_up.commit()


def store_run(batch: DataFrame, root: str, run_id: str, cfg: Config, rejects: DataFrame | None = None,
              late: DataFrame | None = None) -> dict[str, DataFrame]:
    """Write one run's new postings, companies, skills, rejects and late rows under ``root``, publish them
    together, and return what was written.

    A ``skills`` column of the batch becomes rows of the tables ``job_skills`` and ``skills``.
    """
    attempt = Attempt(batch.sparkSession, root, run_id, "store")
    index_missing_runs(attempt, cfg)
    attempt.removed = [p for table in RUN_TABLES for p in attempt.base.of(table, run_id)]
    write = attempt.write

    # The first row of each key, by keys and arrival numbers alone; then those that no other run has.
    keyed = batch.select(_posting_key(cfg).alias("key"), "ingest_seq")
    firsts = materialize(keyed.groupBy("key").agg(F.min("ingest_seq").alias("ingest_seq")), "batch-keys")
    new = materialize(_not_known(attempt, posting_keys(cfg), firsts), "new-keys")
    rows = _flagged(keep_listed(batch, new.select("ingest_seq"), "ingest_seq", "new-postings"))
    # Rebalanced, so that a month is a few files of good size and a large month still many.
    written = {"jobs": write(rows.drop("skills", "skill_names").hint("rebalance", "posting_month"), "jobs", "posting_month")}

    named = written["jobs"].where("company_id IS NOT NULL").select("company_id", F.col("company").alias("name"), F.col("ingest_seq").alias("first_seq"))
    spelled = first_value(named, "company_id", "name", "first_seq").withColumn("key", key_index.key_of(F.col("company_id")))
    added = _not_known(attempt, COMPANY_KEYS, materialize(spelled, "companies"))
    written["companies"] = write(
        added.select("company_id", F.col("company_id").alias("normalized_name"), "name",
                     F.lit(None).cast("string").alias("industry"), F.col("first_seq").cast(ARRIVAL).alias("first_seq")),
        "companies",
    )
    if "skills" in batch.columns:
        of_new = batch.join(written["jobs"].select("ingest_seq"), "ingest_seq", "left_semi")
        written["job_skills"] = write(explode_hits(of_new, "fingerprint").dropDuplicates(["fingerprint", "skill"]), "job_skills")
        written["skills"] = write(
            written["job_skills"].groupBy("skill", "category").agg(F.count(F.lit(1)).alias("frequency")), "skills")
    if rejects is not None:
        written["rejects"] = write(rejects, "rejects")
    if late is not None:
        written["late"] = write(late, "late")

    names = (posting_keys(cfg), COMPANY_KEYS)
    for name, keys in zip(names, (new.select("key"), written["companies"].select(key_index.key_of(F.col("company_id")).alias("key")))):
        key_index.forget(attempt, name, run_id)
        key_index.add(attempt, name, keys.withColumn("of_run", F.lit(run_id)))
    now = attempt.commit()
    for name in names:
        now = key_index.merge(attempt.spark, root, name, now)
    return written


def write_matches(matches: DataFrame, root: str, run_id: str) -> DataFrame:
    """The run's ranked matches as its part of the table ``recommendations``."""
    attempt = Attempt(matches.sparkSession, root, run_id, "recommend")
    attempt.removed = attempt.base.of("recommendations", run_id)
    written = attempt.write(matches, "recommendations")
    attempt.commit()
    return written


def read_table(spark: SparkSession, root: str, name: str, schema: T.StructType, skip_run: str | None = None,
               version: int | None = None) -> DataFrame:
    """Rows of a table in the latest version or an earlier one; an empty frame if there is none yet."""
    parts = snapshot(spark, root, version).of(name)
    return read_parts(spark, root, [p for p in parts if p.run_id != skip_run], schema)


def backfill_table(spark: SparkSession, root: str, run_id: str, cfg: Config) -> int:
    """Write the stored postings of ``run_id`` anew with the roles their titles have today; how many changed.

    The new rows are a new attempt: readers have the old ones until its commit, and after it by version.
    """
    attempt = Attempt(spark, root, run_id, "backfill")
    attempt.removed = attempt.base.of("jobs", run_id)
    if not attempt.removed:
        return 0
    stored = spark.read.option("basePath", f"{root}/jobs").parquet(*[p.path(root) for p in attempt.removed]).drop("run_id", "attempt")
    today = materialize(backfill_role(stored.withColumn("posting_month", F.col("posting_month").cast("string")), cfg), "backfill")
    changed = today.where("role_changed").count()
    if changed:
        attempt.write(today.drop("role_changed").hint("rebalance", "posting_month"), "jobs", "posting_month")
        attempt.commit()
    return changed


def run_log_row(
    spark: SparkSession, run_id: str, started_at: datetime, completed_at: datetime, status: str,
    found: int = 0, validated: int = 0, rejected: int = 0, metadata: dict | None = None,
) -> DataFrame:
    row = (run_id, started_at, completed_at, status, found, validated, rejected,
           json.dumps(metadata or {}, default=str))
    return spark.createDataFrame([row], RUN_LOG)


def append_run(log_row: DataFrame, path: str) -> None:
    log_row.coalesce(1).write.mode("append").parquet(path)


def run_log_from(postings: DataFrame, run: str) -> DataFrame:
    """Run-log rows from tagged postings (columns ``run``, ``posting_date``, ``is_valid``)."""
    return postings.groupBy(F.col(run).alias("run_id")).agg(
        F.min("posting_date").alias("started_at"),
        F.max("posting_date").alias("completed_at"),
        F.lit("completed").alias("status"),
        F.count(F.lit(1)).alias("jobs_found"),
        F.count_if("is_valid").alias("jobs_validated"),
        F.count_if(~F.col("is_valid")).alias("jobs_rejected"),
    )


def add_columns(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """Add missing nullable columns, keep every other column; doing it twice changes nothing."""
    missing = [f for f in wanted.fields if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else df

