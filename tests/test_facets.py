"""Listing by bitmaps and slices against plain filters over the rows."""

from datetime import datetime, timedelta

import pytest

from hirescope.operators import facets, filters
from hirescope.operators.analytics import newest
from hirescope.operators.versions import roll_back, snapshot
from hirescope.schemas import LONG, STRING, TIME, struct

ROWS = struct(ingest_seq=LONG, fingerprint=STRING, posting_date=TIME, country=STRING, source=STRING,
              role_category=STRING, remote_type=STRING, title=STRING)
DAY = datetime(2024, 1, 1)
# One country holds most rows and one day a third; some facets are null or empty.
DATA = [
    (i, f"f{i * 7919 % 1000:03}", None if i % 11 == 0 else DAY if i % 3 == 0 else DAY + timedelta(hours=i % 97),
     None if i % 13 == 0 else "DE" if i % 5 else "FR", f"s{i % 4}", "" if i % 7 == 0 else "data", "remote" if i % 50 == 1 else "hybrid", f"t{i}")
    for i in range(900)
]
TESTS = [{}, {"country": "DE"}, {"country": "FR", "source": "All", "role_category": None, "remote_type": "remote"},
         {"role_category": "", "source": "s2"}, {"country": "nowhere"}]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("listing"))
    rows = spark.createDataFrame(DATA, ROWS)
    facets.add_listing(rows.where("ingest_seq < 600"), root, "1", slice_rows=60)
    facets.add_listing(rows.where("ingest_seq >= 600"), root, "2", slice_rows=60)
    return root, rows.cache()


def expected_counts(rows, tests):
    return {(f, r[0], r[1]) for f in facets.FACETS
            for r in filters.facet_filter(rows, **tests).where(f"{f} IS NOT NULL").groupBy(f).count().collect()}


@pytest.mark.parametrize("tests", TESTS)
def test_counts_and_pages(spark, stored, tests):
    root, rows = stored
    listing = facets.Listing(spark, root)
    kept = filters.facet_filter(rows, **tests)
    assert listing.count(**tests).first()["n"] == kept.count()
    assert {tuple(r) for r in listing.facet_counts(**tests).collect()} == expected_counts(rows, tests)
    for k in (7, 2000):
        page = listing.page(k, **tests)
        assert page.orderBy("rank").collect() == newest(kept, k).select(page.columns).orderBy("rank").collect()


def test_page_opens_few_slices(spark, stored):
    listing = facets.Listing(spark, stored[0])
    every = len(listing.page(2000).inputFiles())
    assert every >= 12 and len(listing.page(20).inputFiles()) == 2  # the first slice of each part
    assert len(listing.page(3, remote_type="remote").inputFiles()) < every / 2


def test_counts_read_no_rows(spark, stored):
    files = facets.Listing(spark, stored[0]).facet_counts(country="DE").inputFiles()
    assert files and all("/listing_bitmaps/" in f for f in files)


def test_compaction_and_repeated_runs(spark, tmp_path):
    root, rows = str(tmp_path), spark.createDataFrame(DATA[:200], ROWS)
    facets.add_listing(rows.where("ingest_seq < 120"), root, "1", slice_rows=50)
    facets.add_listing(rows.where("ingest_seq >= 100"), root, "2", slice_rows=50)
    facets.add_listing(rows.where("ingest_seq >= 120"), root, "2", slice_rows=50)  # in place of the attempt before
    before = snapshot(spark, root).version
    facets.compact(spark, root, slice_rows=50)
    merged = facets.Listing(spark, root)
    assert len(merged.parts) == 1 and merged.count().first()["n"] == 200
    page = merged.page(30, country="DE")
    assert page.collect() == newest(rows.where("country = 'DE'"), 30).select(page.columns).collect()
    facets.compact(spark, root)
    assert snapshot(spark, root).version == before + 1
    roll_back(spark, root, before)
    assert len(facets.Listing(spark, root).parts) == 2 and facets.Listing(spark, root).count(source="s1").first()["n"] == 50


def test_empty_listing(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError):
        facets.Listing(spark, root).page()
    facets.add_listing(spark.createDataFrame([], ROWS), root, "1")
    listing = facets.Listing(spark, root)
    assert listing.count().first()["n"] == 0 and listing.facet_counts(source="s1").isEmpty()
    with pytest.raises(ValueError):
        listing.count(colour="red")
