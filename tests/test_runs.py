"""Whole runs, batch and streaming, and the stored tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF
from hirescope.config import Profile
from hirescope.operators import lookups, store
from hirescope.operators.skills import extract_skills
from hirescope.plans.run import run
from hirescope.schemas import LONG, RUN_LOG, STORED_COMPANIES, STORED_KEYS, STRING, TIME, struct
from hirescope.streaming import counts, ingest
from workloads import inputs as I

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def landed(spark):
    return I.landing(spark, SF)


def test_run_end_to_end(spark, landed, cfg, tmp_path):
    root = str(tmp_path)
    result = run(landed, root, cfg, Profile(), run_id="r1")
    assert result.counts["found"] == result.counts["validated"] + result.counts["rejected"] > 0
    assert result.postings.count() == result.counts["validated"]
    reasons = {r["reasons"][0]: r["count"] for r in result.rejected.groupBy("reasons").count().collect()}
    assert result.rejected.where("NOT array_contains(reasons, 'unreadable_payload')").count() == result.counts["rejected"]
    assert reasons["unreadable_payload"] > 0
    assert spark.read.parquet(f"{root}/rejects").count() == result.rejected.count()
    skills = spark.read.parquet(f"{root}/job_skills")
    assert skills.count() == skills.select("fingerprint", "skill").distinct().count() > 0
    assert spark.read.parquet(f"{root}/recommendations").count() == result.matches.count()
    assert {r["section"] for r in result.analytics.select("section").distinct().collect()} >= {"summary", "top_skills", "country_distribution"}
    assert result.matches.count() <= 20 and result.projects.count() > 0
    jobs = spark.read.parquet(f"{root}/jobs")
    assert jobs.count() == result.counts["validated"]
    # A second run over the same payloads stores nothing new.
    run(landed, root, cfg, Profile(), run_id="r2", extractor=extract_skills)
    assert spark.read.parquet(f"{root}/jobs").count() == jobs.count()
    assert spark.read.parquet(f"{root}/companies").groupBy("normalized_name").count().where("count > 1").isEmpty()
    log = spark.read.schema(RUN_LOG).parquet(f"{root}/runs").orderBy("started_at").collect()
    assert [(r["run_id"], r["status"], r["jobs_validated"]) for r in log] == [("r1", "completed", result.counts["validated"]), ("r2", "completed", result.counts["validated"])]


def test_failed_run_is_logged(spark, landed, cfg, tmp_path):
    def broken(df, cfg):
        raise RuntimeError("no extractor")

    with pytest.raises(RuntimeError):
        run(landed, str(tmp_path), cfg, run_id="bad", extractor=broken)
    row = spark.read.schema(RUN_LOG).parquet(f"{tmp_path}/runs").first()
    assert row["status"] == "failed" and "no extractor" in row["metadata"]


def test_repeated_store_replaces_its_own_rows(spark, make, cfg, tmp_path):
    batch = make({"external_id": "1", "title": "a", "company": "X"}, {"external_id": "2", "title": "b", "company": "x "})
    for _ in range(2):
        written = store.store_run(batch, str(tmp_path), "r1", cfg)
        assert written["jobs"].count() == 2 and written["companies"].count() == 1
    later = store.store_run(make({"external_id": "2", "company": "X"}, {"external_id": "3", "company": "Y"}), str(tmp_path), "r2", cfg)
    assert [r["external_id"] for r in later["jobs"].collect()] == ["3"]
    assert [r["normalized_name"] for r in later["companies"].collect()] == ["y"]
    assert store.read_table(spark, str(tmp_path), "jobs", STORED_KEYS).count() == 3
    assert store.read_table(spark, str(tmp_path), "none", STORED_KEYS).count() == 0


def test_what_is_stored_can_be_listed(spark, make, cfg, tmp_path):
    root = str(tmp_path)
    batch = make({"external_id": "1", "title": "Data Analyst", "company": " Acme"}, {"external_id": "2", "title": "b", "company": None})
    store.store_run(batch, root, "r1", cfg)
    jobs = spark.read.parquet(f"{root}/jobs")
    listed = lookups.active_listings(jobs, store.read_table(spark, root, "companies", STORED_COMPANIES))
    assert {(r["ingest_seq"], r["company"]) for r in listed.collect()} == {(0, " Acme"), (1, "Unknown")}
    assert (store.backfill_table(spark, root, "r1", cfg), store.backfill_table(spark, root, "r1", cfg)) == (1, 0)
    # The folder holds the rows before and after; a reader takes those of one version.
    columns = struct(ingest_seq=LONG, role_category=STRING)
    roles = lambda version=None: [r["role_category"] for r in store.read_table(spark, root, "jobs", columns, version=version).orderBy("ingest_seq").collect()]
    assert roles() == ["analytics", None] and roles(version=1) == [None, None]


def test_unpublished_run_is_not_read(spark, make, cfg, tmp_path):
    root = str(tmp_path)
    store.store_run(make({"external_id": "1"}), root, "r1", cfg)
    rows = make({"external_id": "2"})
    store.store_rows(rows, rows.where("false"), cfg).write.partitionBy("posting_month").parquet(f"{root}/jobs/run_id=broken")
    assert [r["external_id"] for r in store.read_table(spark, root, "jobs", STORED_KEYS).collect()] == ["1"]
    assert store.store_run(make({"external_id": "2"}), root, "r2", cfg)["jobs"].count() == 1


def test_add_columns_twice(make):
    wanted = struct(title=TIME, extra=TIME)
    once = store.add_columns(make({"title": "a"}), wanted)
    assert store.add_columns(once, wanted).schema == once.schema and dict(once.dtypes)["title"] == "string"


def test_stream_in_many_batches_equals_store_rules(spark, landed, cfg, tmp_path):
    """Several files, one per batch: each key is stored once, by the batch that saw it first."""
    source = str(tmp_path / "landing")
    ordered = landed.orderBy("ingest_seq").collect()
    for i in range(3):
        part = spark.createDataFrame(ordered[i * 70:(i + 1) * 70], landed.schema)
        part.coalesce(1).write.mode("append").parquet(source)
    root, checkpoint = str(tmp_path / "store"), str(tmp_path / "cp")
    for _ in range(2):
        ingest.ingest(ingest.read_landing(spark, source, 1), root, checkpoint, cfg).awaitTermination()
    jobs = spark.read.parquet(f"{root}/jobs")
    assert jobs.select("run_id").distinct().count() > 1
    assert jobs.groupBy("source", "external_id").count().where("count > 1").isEmpty()
    rejects = spark.read.parquet(f"{root}/rejects")
    late = ingest.late_postings(rejects)
    assert late.where(F.col("posting_date") > F.lit(AS_OF - timedelta(days=29))).isEmpty() and late.count() > 0


def test_a_batch_is_worked_out_once_for_all_boards(spark, cfg, tmp_path):
    """Also rows of boards that nobody knows, or of none, which are rejected."""
    rows = [(1, "remoteok", "", '{"id": "1", "position": "Junior Data Analyst"}'), (2, "lever", "a", "<broken"), (3, "odd=/", "", "{}"), (4, None, "", "{}")]
    source, seen = str(tmp_path / "landing"), spark.sparkContext.accumulator(0)
    spark.createDataFrame(rows, "ingest_seq LONG, source STRING, context STRING, payload STRING").coalesce(1).write.parquet(source)

    def count(text):
        seen.add(1)
        return text

    landing = ingest.read_landing(spark, source).withColumn("payload", F.udf(count, "string")("payload"))
    root = str(tmp_path / "store")
    ingest.ingest(landing, root, str(tmp_path / "cp"), cfg).awaitTermination()
    assert seen.value == len(rows)
    unread = spark.read.parquet(f"{root}/rejects").where("array_contains(reasons, 'unreadable_payload')")
    assert {(int(r["ingest_seq"]) >> 31, r["source"]) for r in unread.collect()} >= {(2, "lever"), (3, "odd=/"), (4, None)}


def test_window_counts_over_batches(spark, make, cfg, tmp_path):
    source = str(tmp_path / "in")
    # The last one comes more than a year late and still counts.
    days = [datetime(2024, 1, d) for d in (1, 2, 3, 9, 2)] + [datetime(2022, 11, 5)]
    rows = make(*[{"title": "Data Analyst", "posting_date": d} for d in days])
    for i in range(len(days)):
        rows.where(F.col("ingest_seq") == i).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    path = str(tmp_path / "out")
    counts.write_updates(counts.windowed_counts(stream, cfg, "7 days"), path, str(tmp_path / "cp")).awaitTermination()
    schema = counts.windowed_counts(rows, cfg, "7 days").schema
    want = counts.windowed_counts(rows, cfg, "7 days")
    assert sorted(map(tuple, counts.latest_counts(spark, path, schema).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
