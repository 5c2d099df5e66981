"""Board mappings on payloads that are not tidy."""

import json

from conftest import column
from hirescope import sources
from hirescope.schemas import LANDING, posting_struct
from hirescope.sources.registry import one_record
from pyspark.sql import functions as F


def landing(spark, *rows):
    full = [(s, c, p if isinstance(p, str) or p is None else json.dumps(p), i, None) for i, (s, c, p) in enumerate(rows)]
    return spark.createDataFrame(full, LANDING)


def first(spark, cfg, board, context, payload):
    found = sources.map_source(landing(spark, (board, context, payload)), board, cfg).collect()
    return found[0] if found else None


def test_unreadable_payloads_are_set_aside(spark, cfg):
    rows = [
        ("remoteok", None, {"id": 1, "position": "Analyst", "company": "A"}), ("remoteok", None, "{broken"),
        ("remoteok", None, None), ("greenhouse", "stripe", {"id": 5}), ("nowhere", None, {"id": 1}),
        ("smartrecruiters", "x", [{"id": "a", "name": "One"}, {"id": "b"}, {"id": "c", "name": "Two"}]),
        ("smartrecruiters", "x", {"content": "none"}),
    ]
    df = landing(spark, *rows)
    union = sources.union_sources(df, cfg)
    assert column(union, "title") == ["Analyst", "One", "Two"]
    assert len(set(column(union, "ingest_seq"))) == 3
    assert sorted(r["ingest_seq"] for r in sources.quarantined(df, cfg).collect()) == [1, 2, 3, 4, 6]
    each = [t for b in sources.SOURCES for t in column(sources.map_source(df, b, cfg), "title")]
    assert sorted(each) == ["Analyst", "One", "Two"]


def test_arrival_numbers_neither_wrap_nor_meet(spark, cfg):
    payload = json.dumps([{"id": "a", "name": "One"}, {"id": "b", "name": "Two"}])
    numbers = [10**18, 10**18 + 1, 1_700_000_000_000_000, 1_700_000_000_000_000 + 2**44, 2**63 - 1]
    df = spark.createDataFrame([("smartrecruiters", "x", payload, n, None) for n in numbers], LANDING)
    got = sorted(r["ingest_seq"] for r in sources.union_sources(df, cfg).collect())
    assert got == sorted(n * 2**31 + place for n in numbers for place in (0, 1))


def test_remoteok(spark, cfg):
    base = {"id": 7, "position": "Junior Dev", "company": "A", "location": "Vienna, Austria", "remote": False, "salary_min": 50000.7, "salary_max": 0}
    r = first(spark, cfg, "remoteok", None, base)
    assert (r["external_id"], r["country"], r["remote_type"], r["salary_min"], r["salary_max"]) == ("7", "United States", "onsite", 50000, None)
    assert r["url"] == r["apply_url"] == "https://remoteok.com/remote-jobs/7"
    modes = [(True, "remote"), (None, "onsite"), ("", "onsite"), ("yes", "remote"), (0, "onsite")]
    assert [first(spark, cfg, "remoteok", None, {**base, "remote": m})["remote_type"] for m, _ in modes] == [w for _, w in modes]
    del base["remote"]
    assert first(spark, cfg, "remoteok", None, base)["remote_type"] == "remote"
    assert first(spark, cfg, "remoteok", None, {**base, "salary_max": "lots"}) is None
    assert first(spark, cfg, "remoteok", None, {**base, "id": None}) is None
    assert first(spark, cfg, "remoteok", None, {**base, "company": ""}) is None


def test_eu_startup_company_may_be_text(spark, cfg):
    r = first(spark, cfg, "eu_startup_jobs", None, {"title": "Lead", "company": "Plain", "location": "Berlin, DE", "url": "u"})
    assert (r["company"], r["city"], r["country"], r["remote_type"], r["experience_level"], r["url"]) == ("Plain", "Berlin", "Berlin, DE", "hybrid", "Senior", "u")


def test_wttj(spark, cfg):
    r = first(spark, cfg, "welcometothejungle", None, {"title": "Dev", "organization": "Org", "offices": [], "experience_level_minimum": 4, "remote": "full_remote", "salary_minimum": "x", "slug": "s"})
    assert (r["company"], r["country"], r["experience_level"], r["remote_type"], r["salary_min"], r["external_id"]) == ("Org", "", "Senior", "full_remote", None, "s")
    assert r["url"] == "https://www.welcometothejungle.com/en/jobs"


def test_lever_and_workday(spark, cfg):
    r = first(spark, cfg, "lever", "git-hub", {"text": "Sr Dev", "id": "1", "createdAt": 0, "hostedUrl": "h"})
    assert (r["company"], r["posting_date"], r["apply_url"], r["country"]) == ("Git-Hub", None, "h", "")
    r = first(spark, cfg, "workday", "amazon", {"name": "Dev", "bulletFields": ["R1"]})
    assert (r["title"], r["external_id"], r["url"], r["company"]) == ("Dev", "R1", "https://amazon.myworkdayjobs.com", "Amazon")


def test_indeed_reads_whole_pages(spark, cfg):
    card = '<div class="job_seen_beacon"><h2 class="jobTitle"><a href="/j{0}" id="job_{0}"><span>Title {0}</span></a></h2><span class="date">{0} days ago</span></div>'
    page = "<html>" + "".join(card.format(i) for i in range(30)) + "</html>"
    found = sources.map_source(landing(spark, ("indeed", "de|Germany", page)), "indeed", cfg)
    assert found.count() == 30
    outside = '<div class="result"><h2 class="jobTitle"><a href="/x"><span>Ad</span></a></h2></div>'
    inside = f'<div class="jobsearch-ResultsList">{outside.replace("Ad", "Job")}</div>'
    both = sources.map_source(landing(spark, ("indeed", "de|Germany", outside + inside)), "indeed", cfg)
    assert column(both, "title") == ["Job"]
    r = found.orderBy("ingest_seq").first()
    assert (r["external_id"], r["country"], r["company"], r["url"], r["city"]) == ("0", "Germany", "Unknown", "https://www.indeed.com/j0", "")


def test_linkedin_needs_all_parts(spark, cfg):
    page = (
        '<li><h3 class="base-search-card__title">A &amp; B</h3><h4 class="base-search-card__subtitle">C</h4>'
        '<a href="https://x.com/jobs/view/analyst-at-c-123?x=1" class="base-card__full-link"></a><time datetime="2024-01-02"></time></li>'
        '<li><h3 class="base-search-card__title">No link</h3><h4 class="base-search-card__subtitle">C</h4></li>'
    )
    found = sources.map_source(landing(spark, ("linkedin", "Ireland", page)), "linkedin", cfg).collect()
    assert [(r["title"], r["external_id"], r["url"], r["country"]) for r in found] == [("A & B", "123", "https://x.com/jobs/view/analyst-at-c-123", "Ireland")]


def test_new_board_is_one_registration(spark, cfg):
    board = sources.Source(
        "mine", one_record("t STRING"),
        lambda p, context, _cfg: F.when(p["t"].isNotNull(), posting_struct(source=F.lit("mine"), title=p["t"], company=context)),
    )
    sources.register(board)
    try:
        got = sources.union_sources(landing(spark, ("mine", "Acme", {"t": "Dev"})), cfg).first()
        assert (got["title"], got["company"], got["employment_type"], got["visa_sponsorship"]) == ("Dev", "Acme", "unknown", False)
    finally:
        del sources.SOURCES["mine"]
