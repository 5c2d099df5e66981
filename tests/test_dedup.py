"""The two-key rule against a plain loop, with hot keys and chains."""

import random

import pytest
from pyspark.sql import functions as F

from hirescope.operators import dedup, lookups
from hirescope.sources import dedup_and_cap


def loop(rows):
    seen, kept = set(), []
    for key, fp, seq in sorted(rows, key=lambda r: r[2]):
        if ("k", key) not in seen and ("f", fp) not in seen:
            seen |= {("k", key), ("f", fp)}
            kept.append(seq)
    return kept


def run(spark, rows):
    edges = spark.createDataFrame([(str(k).encode(), str(f).encode(), s) for k, f, s in rows], "k BINARY, f BINARY, seq BIGINT")
    return sorted(r[0] for r in dedup.greedy_kept(edges).collect())


@pytest.mark.parametrize("share", [0.33, 0.5])
def test_random(spark, share):
    rng = random.Random(7)
    # A third or half of all rows share one key; the rest collide often on both keys.
    rows = [(0 if rng.random() < share else rng.randrange(60), rng.randrange(60), s) for s in rng.sample(range(10_000), 300)]
    assert run(spark, rows) == loop(rows)


def test_chain(spark):
    rows = [("k1", "f1", 1), ("k1", "f2", 2), ("k2", "f2", 3), ("k2", "f3", 4), ("k3", "f3", 5)]
    assert run(spark, rows) == [1, 3, 5]
    assert run(spark, []) == []


def chain(n, start=0):
    """Rows of which each shares a key with the one before and the one after it."""
    return [(f"{start}k{j // 2}", f"{start}f{(j + 1) // 2}", start + j) for j in range(n)]


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    real = dedup.materialize
    monkeypatch.setattr(dedup, "materialize", lambda df, name: written.append(name) or real(df, name))
    rows = chain(10_000)
    assert run(spark, rows) == loop(rows)
    assert written.count("dedup-kept") == dedup.PLAIN_ROUNDS + 1


def test_components_beyond_one_task_go_on_in_rounds(spark, monkeypatch):
    rng = random.Random(5)
    rows = [*chain(30), *chain(9, 1000), *[(rng.randrange(40), rng.randrange(40), 5000 + i) for i in range(200)]]
    for plain, largest in ((1, 10), (2, 29), (1, 1000), (1, 0)):
        edges = spark.createDataFrame([(str(k).encode(), str(f).encode(), s) for k, f, s in rows], "k BINARY, f BINARY, seq BIGINT")
        edges = edges.withColumn("seq", F.col("seq").cast("decimal(30,0)"))
        assert sorted(int(r[0]) for r in dedup.greedy_kept(edges, plain, largest).collect()) == loop(rows)


def test_no_python_in_tasks(make):
    plan = dedup.dedup_postings(make({}, {}))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_postings(make):
    rows = [
        {"external_id": "1", "title": "A ", "company": "x"},
        {"external_id": "2", "title": "a", "company": "X"},   # same title and company
        {"external_id": "2", "title": "b", "company": "x"},   # its id was only on a dropped row
        {"external_id": "1", "title": "c", "company": "x"},   # id of a kept row
        {"external_id": "9", "title": None, "company": None},
    ]
    kept = dedup.dedup_postings(make(*rows))
    assert sorted(r["ingest_seq"] for r in kept.collect()) == [0, 2, 4]


def test_companies(spark, make):
    stored = spark.createDataFrame([("acme", "ACME", 0)], "normalized_name STRING, name STRING, first_seq BIGINT")
    df = make({"company": " Acme"}, {"company": "Beta"}, {"company": "BETA "}, {"company": ""}, {"company": None})
    got = sorted(map(tuple, dedup.company_upsert(df, stored).collect()))
    assert got == [("acme", "ACME", 0), ("beta", "Beta", 1)]


def test_new_postings(spark, make, cfg):
    stored = spark.createDataFrame([("a", "1")], "source STRING, external_id STRING")
    df = make(
        {"source": "a", "external_id": "1"}, {"source": "b", "external_id": "1"},
        {"source": "b", "external_id": "1"}, {"source": "a", "external_id": "2"},
    )
    assert sorted(r["ingest_seq"] for r in lookups.new_postings(df, stored, cfg).collect()) == [1, 3]
    from dataclasses import replace

    legacy = replace(cfg, legacy_store_key=True)
    assert sorted(r["ingest_seq"] for r in lookups.new_postings(df, stored, legacy).collect()) == [3]


def test_cap_counts_distinct_postings(make, cfg):
    from dataclasses import replace

    small = replace(cfg, source_caps={"linkedin": 2, "welcometothejungle": 1})
    df = make(
        {"source": "linkedin", "external_id": "1"}, {"source": "linkedin", "external_id": "1"},
        {"source": "linkedin", "external_id": "2"}, {"source": "linkedin", "external_id": "3"},
        {"source": "other", "external_id": "1"}, {"source": "other", "external_id": "2"}, {"source": "other", "external_id": "2"},
        {"source": "welcometothejungle", "external_id": "1"}, {"source": "welcometothejungle", "external_id": "2"},
    )
    assert sorted(r["ingest_seq"] for r in dedup_and_cap(df, small).collect()) == [0, 2, 4, 5, 7]


def test_terms(spark):
    df = spark.createDataFrame([("Data", 1), ("data", 2), ("Ops", 3)], "t STRING, i INT")
    assert [tuple(r) for r in dedup.distinct_terms(df, "t", "i").orderBy("i").collect()] == [("Data", 1), ("Ops", 3)]


def test_company_join(spark, make):
    posts = make({}, {}).withColumn("company_id", F.col("ingest_seq"))
    names = spark.createDataFrame([(0, "Acme")], "company_id BIGINT, name STRING")
    got = lookups.join_company(posts.drop("company"), names)
    assert [r["company"] for r in got.orderBy("ingest_seq").collect()] == ["Acme", "Unknown"]
