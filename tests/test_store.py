"""Versions of the store: attempts that stop half way, older versions, conflicts; and the key index."""

import random

import pytest
from pyspark.sql import functions as F

from hirescope.operators import key_index, store, versions
from hirescope.operators.versions import Attempt, Part, Snapshot
from hirescope.schemas import STRING, struct

JOBS = struct(external_id=STRING, title=STRING, role_category=STRING, run_id=STRING)


def jobs(spark, root, version=None):
    return sorted((r["external_id"], r["title"]) for r in store.read_table(spark, root, "jobs", JOBS, version=version).collect())


@pytest.fixture
def stopped(monkeypatch):
    """Attempts stop after writing so many parts."""
    def after(n):
        real = Attempt.write

        def write(self, df, table, *args, **kwargs):
            if len(self.added) >= n:
                raise RuntimeError("executor lost")
            return real(self, df, table, *args, **kwargs)

        monkeypatch.setattr(Attempt, "write", write)

    yield after
    monkeypatch.undo()


@pytest.mark.parametrize("parts", [0, 1, 2, 3])
def test_a_repeated_run_that_stops_half_way_changes_nothing(spark, make, cfg, tmp_path, stopped, monkeypatch, parts):
    root = str(tmp_path)
    store.store_run(make({"external_id": "1", "title": "a", "company": "X"}), root, "r1", cfg)
    before = jobs(spark, root), versions.snapshot(spark, root)
    stopped(parts)
    with pytest.raises(RuntimeError):
        store.store_run(make({"external_id": "1", "title": "b"}, {"external_id": "2", "title": "c"}), root, "r1", cfg)
    assert (jobs(spark, root), versions.snapshot(spark, root)) == before == ([("1", "a")], before[1])
    monkeypatch.undo()
    store.store_run(make({"external_id": "1", "title": "b"}, {"external_id": "2", "title": "c"}), root, "r1", cfg)
    assert jobs(spark, root) == [("1", "b"), ("2", "c")]
    assert jobs(spark, root, version=before[1].version) == [("1", "a")]
    # The attempt that stopped left folders that nobody reads; vacuum takes them and what no kept version reads.
    assert versions.vacuum(spark, root, keep=1) > 0 and jobs(spark, root) == [("1", "b"), ("2", "c")]
    assert versions.vacuum(spark, root, keep=1) == 0


def test_a_first_run_that_stops_half_way_is_not_there(spark, make, cfg, tmp_path, stopped, monkeypatch):
    root = str(tmp_path)
    stopped(1)
    with pytest.raises(RuntimeError):
        store.store_run(make({"external_id": "1", "title": "a"}), root, "r1", cfg)
    assert jobs(spark, root) == [] and versions.snapshot(spark, root) == Snapshot()
    monkeypatch.undo()
    # Its key counts as new for the run that comes next.
    store.store_run(make({"external_id": "1", "title": "z"}), root, "r2", cfg)
    assert jobs(spark, root) == [("1", "z")]


def test_a_backfill_that_stops_half_way_changes_nothing(spark, make, cfg, tmp_path, stopped, monkeypatch):
    root = str(tmp_path)
    store.store_run(make({"external_id": "1", "title": "Data Analyst"}), root, "r1", cfg)
    roles = lambda v=None: [r["role_category"] for r in store.read_table(spark, root, "jobs", JOBS, version=v).collect()]
    monkeypatch.setattr(Attempt, "commit", lambda self: (_ for _ in ()).throw(RuntimeError("driver lost")))
    with pytest.raises(RuntimeError):
        store.backfill_table(spark, root, "r1", cfg)
    monkeypatch.undo()
    assert roles() == [None]
    assert store.backfill_table(spark, root, "r1", cfg) == 1 and roles() == ["analytics"] and roles(1) == [None]
    assert store.backfill_table(spark, root, "none", cfg) == 0
    # Roll back and forth; every version stays readable and is listed.
    versions.roll_back(spark, root, 1)
    assert roles() == [None] and roles(2) == ["analytics"]
    versions.roll_back(spark, root, 2)
    assert roles() == ["analytics"]
    log = versions.history(spark, root).orderBy("version").collect()
    assert [(r["version"], r["operation"]) for r in log] == [(1, "store"), (2, "backfill"), (3, "roll_back"), (4, "roll_back")]
    with pytest.raises(ValueError):
        versions.snapshot(spark, root, 9)


def test_of_two_writers_one_fails_without_effect(spark, tmp_path):
    root, rows = str(tmp_path), spark.range(3)
    a, b = Attempt(spark, root, "a", "store"), Attempt(spark, root, "b", "store")
    a.write(rows, "t")
    b.write(rows, "t")
    a.commit()
    with pytest.raises(versions.Conflict):
        b.commit()
    assert [p.run_id for p in versions.snapshot(spark, root).parts] == ["a"]


def test_a_long_log_is_read_from_its_last_whole_record(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "WHOLE_EVERY", 4)
    root, live, states = str(tmp_path), [], [()]
    for i in range(11):
        attempt = Attempt(spark, root, f"r{i}", "store")
        attempt.added = [Part("t", f"r{i}", attempt.id)]
        attempt.removed = [p for p in attempt.base.parts if i % 3 == 2 and p.run_id != "r0"]
        live = [p for p in live if p not in attempt.removed] + attempt.added
        attempt.commit()
        states.append(tuple(live))
    for version, state in enumerate(states[1:], 1):
        assert set(versions.snapshot(spark, root, version).parts) == set(state)
    versions.vacuum(spark, root, keep=2)
    assert set(versions.snapshot(spark, root).parts) == set(live) and versions.history(spark, root).count() < 11


# Key index


def keys_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string").select(key_index.key_of(F.col("name")).alias("key"), "name")


def stored(spark, root, run, names, level=0):
    attempt = Attempt(spark, root, run, "store")
    key_index.add(attempt, "k", keys_of(spark, names).select("key", F.lit(run).alias("of_run")), level)
    attempt.commit()


def known_names(spark, root, names, skip=None):
    asked = keys_of(spark, names)
    found = key_index.known(spark, root, versions.snapshot(spark, root), "k", asked.select("key"), skip)
    return {r["name"] for r in asked.join(found, "key").collect()}


def test_index_knows_what_is_stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_index, "PAGE_KEYS", 20)
    root, rng = str(tmp_path), random.Random(0)
    assert known_names(spark, root, ["1"]) == set()
    first, second = {str(rng.randrange(3000)) for _ in range(1200)}, {str(rng.randrange(3000, 4000)) for _ in range(60)}
    stored(spark, root, "a", first)
    stored(spark, root, "b", second)
    assert max(p.pages for p in versions.snapshot(spark, root).parts) > 1
    asked = {str(i) for i in range(0, 5000, 3)}
    assert known_names(spark, root, asked) == asked & (first | second)
    assert known_names(spark, root, asked, skip="a") == asked & second


def test_lookup_reads_only_buckets_that_may_hold_a_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_index, "PAGE_KEYS", 600)
    monkeypatch.setattr(key_index, "FOLDER_PAGES", 2)
    root = str(tmp_path)
    stored(spark, root, "a", [f"old{i}" for i in range(20_000)])
    parts = versions.snapshot(spark, root).of("k")
    new = keys_of(spark, [f"new{i}" for i in range(5000)]).select("key")
    alarms = key_index.candidates(spark, root, parts, "k", new)
    assert alarms.count() < 0.01 * 5000
    one = key_index.candidates(spark, root, parts, "k", keys_of(spark, ["old7"]).select("key"))
    places = [(r["attempt"], r["bucket"]) for r in one.collect()]
    assert len(places) == 1
    rows = key_index.in_buckets(spark, root, "k", key_index._KEYS, parts, places)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and f"(bucket#" in plan and "IN (" not in plan.split("PartitionFilters")[0]
    files = rows.select(F.input_file_name().alias("f")).distinct().count()
    everything = versions.read_parts(spark, root, parts, key_index._KEYS).select(F.input_file_name().alias("f")).distinct().count()
    assert files < everything / 10


def test_merges_bound_the_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_index, "FAN_IN", 3)
    monkeypatch.setattr(key_index, "PAGE_KEYS", 4)
    root = str(tmp_path)
    for i in range(10):
        stored(spark, root, f"r{i}", [f"{i}-{j}" for j in range(5)])
        key_index.merge(spark, root, "k")
        levels = [p.level for p in versions.snapshot(spark, root).of("k")]
        assert all(levels.count(n) < 3 for n in levels)
    assert levels.count(2) == 1 and len(levels) == 2
    every = {f"{i}-{j}" for i in range(12) for j in range(5)}
    assert known_names(spark, root, every) == {f"{i}-{j}" for i in range(10) for j in range(5)}
    assert known_names(spark, root, every, skip="r3") == {f"{i}-{j}" for i in range(10) if i != 3 for j in range(5)}
    # A run whose keys were merged with others' is taken out of the merged part.
    attempt = Attempt(spark, root, "r3", "store")
    key_index.forget(attempt, "k", "r3")
    attempt.commit()
    assert known_names(spark, root, every) == {f"{i}-{j}" for i in range(10) if i != 3 for j in range(5)}


def test_repeated_run_after_a_merge(spark, make, cfg, tmp_path, monkeypatch):
    monkeypatch.setattr(key_index, "FAN_IN", 2)
    root = str(tmp_path)
    for i in range(3):
        store.store_run(make({"external_id": str(i), "title": f"t{i}", "company": f"C{i}"}), root, f"r{i}", cfg)
    store.store_run(make({"external_id": "1", "title": "again"}, {"external_id": "2", "title": "known"}), root, "r0", cfg)
    assert jobs(spark, root) == [("1", "t1"), ("2", "t2")]
    # Key 0 went with the first attempt of r0, so it is new again.
    store.store_run(make({"external_id": "0", "title": "new", "company": "c0 "}), root, "r9", cfg)
    assert jobs(spark, root) == [("0", "new"), ("1", "t1"), ("2", "t2")]
    names = store.read_table(spark, root, "companies", struct(company_id=STRING)).collect()
    assert sorted(r["company_id"] for r in names) == ["c0", "c1", "c2"]


def test_jobs_stored_under_another_key_are_known(spark, make, cfg, tmp_path):
    from dataclasses import replace

    root, legacy = str(tmp_path), replace(cfg, legacy_store_key=True)
    store.store_run(make({"external_id": "1", "title": "a"}), root, "r1", cfg)
    other = make({"external_id": "1", "title": "b", "source": "other"}, {"external_id": "2", "title": "c", "source": "other"})
    store.store_run(other, root, "r2", legacy)
    assert jobs(spark, root) == [("1", "a"), ("2", "c")]
