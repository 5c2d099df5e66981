"""The report that is kept up to date against the one from all rows; logs of running results."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hirescope.operators import analytics as an
from hirescope.operators import incremental, skills, versions
from hirescope.schemas import LONG, STRING, TIME, struct
from hirescope.streaming import counts, ingest, logs


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(logs, "FAN_IN", 3)


def postings(make, rng, n, start):
    rows = [{"external_id": f"{start + i}", "title": "Data Analyst", "company": rng.choice(["A", "B", "", None, "C"]), "country": rng.choice(["Remote", "Japan", None]),
             "remote_type": rng.choice(["remote", "hybrid", None]), "experience_level": rng.choice(["Entry-Level", "Senior"]), "source": rng.choice("xyz"),
             "salary_min": rng.choice([None, 10, 20, 70_000, -5]), "salary_max": rng.choice([None, None, 90_000]), "visa_sponsorship": rng.random() < 0.5}
            for i in range(n)]
    df = make(*rows).withColumn("normalized_title", F.concat(F.lit("t"), F.col("external_id").cast("int") % 4))
    return df.withColumn("skill_names", F.when(F.col("external_id").cast("int") % 3 == 0, F.array(F.lit("sql"), F.lit("excel"))).otherwise(F.array(F.lit("sql"))))


def as_rows(df):
    return sorted(map(tuple, df.select("section", "rank", "key", "value").collect()), key=str)


def from_scratch(parts):
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return as_rows(an.analytics_long(whole, skills.explode_names(whole, "country")))


def test_report_equals_that_of_all_rows(spark, make, tmp_path, few):
    rng, root, live = random.Random(3), str(tmp_path), {}

    def add(run, n):
        live[run] = postings(make, rng, n, len(live) * 100)
        incremental.add_run(root, run, live[run], skills.explode_names(live[run], "country"))

    for i in range(5):
        add(f"r{i}", 9)
    assert as_rows(incremental.report(spark, root)) == from_scratch(list(live.values()))
    add("r1", 4)  # repeated, with other rows
    incremental.withdraw_run(spark, root, "r3")
    del live["r3"]
    incremental.withdraw_run(spark, root, "nobody")
    assert as_rows(incremental.report(spark, root)) == from_scratch(list(live.values()))
    levels = [p.level for p in versions.snapshot(spark, root).of("changes")]
    assert all(levels.count(level) < 3 for level in levels)
    for run in list(live):
        incremental.withdraw_run(spark, root, run)
    assert incremental.summed(logs.live(spark, root, "changes", incremental.TALLY)).count() == 0


def dated(spark, days, start=0):
    return spark.createDataFrame([(f"{start + i}", "s", "Data Analyst", datetime(2024, 1, 1) + timedelta(days=d) if d is not None else None)
                                  for i, d in enumerate(days)], "external_id string, source string, title string, posting_date timestamp")


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_rows_have_an_output_of_their_own(spark, cfg, tmp_path, few):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[0, 1, 8], [40, 2, 3], [41, 9, 11, None], [5, 44], [45, 46], [1]]
    for i, days in enumerate(batches):
        dated(spark, days, 10 * i).coalesce(1).write.mode("append").parquet(source)
    query = counts.count_windows(stream(spark, source, dated(spark, []).schema), cfg, "7 days", None, "30 days", root, str(tmp_path / "cp"))
    query.awaitTermination()
    late = logs.live(spark, root, "late", struct(external_id=STRING, posting_date=TIME))
    assert sorted(r["external_id"] for r in late.collect()) == ["21", "30", "50"]  # day 9 against 40 - 30, day 5 against 11, day 1 against 16
    counted = counts.counted_windows(spark, root)
    assert counted.agg(F.sum("n")).first()[0] + late.count() == sum(d is not None for b in batches for d in b)
    assert len(versions.snapshot(spark, root).of("additions")) < 5
    # The last batch again, as after a failure between its commit and the checkpoint's: nothing changes.
    before = versions.snapshot(spark, root).version
    assert logs.begin(spark, root, len(batches) - 1)[0] is None and versions.snapshot(spark, root).version == before


def test_every_row_of_a_deduplicated_stream_is_in_one_output(spark, cfg, tmp_path, few):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    batches = [[("a", 1), ("b", 2), ("a", 0)], [("a", 5), ("c", 30)], [("b", 4), ("b", 8), ("d", 31)], [("a", 12), ("c", 29), ("c", 60)], [("c", 61), ("a", 62), (None, 60)]]
    schema = struct(source=STRING, external_id=STRING, landed_at=TIME)
    for batch in batches:
        spark.createDataFrame([("s", k, at(h)) for k, h in batch], schema).coalesce(1).write.mode("append").parquet(source)
    ingest.dedup_to(stream(spark, source, schema), "landed_at", "24 hours", cfg, root, str(tmp_path / "cp")).awaitTermination()
    got = {kind: sorted((r["external_id"] or "-", int((r["landed_at"] - at(0)).total_seconds()) // 3600)
                        for r in logs.live(spark, root, kind, schema).collect()) for kind in ("unique", "repeats", "late")}
    # Horizons by batch: none, 2 - 24, 30 - 24 = 6, 31 - 24 = 7, 60 - 24 = 36.
    assert got == {"unique": [("-", 60), ("a", 0), ("a", 12), ("a", 62), ("b", 2), ("b", 8), ("c", 30), ("c", 61), ("d", 31)],
                   "repeats": [("a", 1), ("a", 5), ("c", 29), ("c", 60)], "late": [("b", 4)]}
    assert sum(map(len, got.values())) == sum(map(len, batches))


def test_updates_are_read_from_few_folders(spark, tmp_path, few):
    """Twenty batches, of which the last value of each key is read."""
    root, schema = str(tmp_path), struct(skill=STRING, n=LONG)
    logged = counts._logged(schema)
    for i in range(20):
        attempt = versions.Attempt(spark, root, f"batch-{i}", "batch")
        attempt.write(spark.createDataFrame([(f"s{i % 7}", i, i), ("all", i, i)], logged), "updates")
        attempt.commit()
        logs.merge(spark, root, "updates", logged, counts._last)
    assert counts.log_parts(spark, root) <= 2 * 3  # at most two parts on each of three levels
    got = {r["skill"]: r["n"] for r in counts.latest_counts(spark, root, schema).collect()}
    assert got == {"all": 19, **{f"s{i % 7}": i for i in range(20)}}
