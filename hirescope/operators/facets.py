"""A listing that is read by page and facet: clustered postings and a bitmap per facet value.

The rows of a run are range-partitioned newest first into slices, one folder each, and
numbered in that order, so the k newest rows lie in the first slices. For every value
of a facet and every 32,768 row numbers one bitmap tells the rows that have the value.
Tests on facets are bitmaps of a bucket and-ed together: counts never read the rows,
and a page opens only the slices its rows lie in. Many postings of one day or value
are no hot key: ties are split by fingerprint and arrival, bitmaps are made inside
a slice and hold at most 4 KB.

Rows and bitmaps are two tables of a versioned store and become readable together.
Each run adds a part; :func:`compact` merges all parts into one.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hirescope.operators.analytics import newest, newest_first
from hirescope.operators.filters import facet_filter
from hirescope.operators.versions import Attempt, Part, read_parts, snapshot
from hirescope.schemas import LONG, STRING, struct

FACETS = ("country", "source", "role_category", "remote_type")
SLICE_ROWS = 1_000_000
LISTING, BITMAPS = "listing", "listing_bitmaps"
_BITMAP = struct(attempt=STRING, facet=STRING, value=STRING, bucket=LONG, bits=T.BinaryType(), n=LONG)
_ANY = "any"  # the bitmaps of all rows
_OWN = ("row_id", "slice", "run_id", "attempt")
# Row number: slice in the bits from 33 on, bucket from 15 on, bit below.
_BUCKET, _SLICE = 15, 33


def _write(attempt: Attempt, rows: DataFrame, slice_rows: int) -> None:
    slices = max(1, -(-rows.count() // slice_rows))
    order = newest_first()
    clustered = rows.repartitionByRange(slices, *order).sortWithinPartitions(*order)
    numbered = clustered.withColumn("row_id", F.monotonically_increasing_id()).withColumn("slice", F.shiftright("row_id", _SLICE))
    written = attempt.write(numbered, LISTING, "slice")

    values = [F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in FACETS]
    every = F.struct(F.lit(_ANY).alias("facet"), F.lit("").alias("value"))
    bits = (
        written.select("row_id", F.inline(F.array(every, *values)))
        .where(F.col("value").isNotNull())
        .groupBy("facet", "value", F.shiftright("row_id", _BUCKET).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("row_id").bitwiseAND((1 << _BUCKET) - 1)).alias("bits"))
        .withColumn("n", F.bitmap_count("bits"))
    )
    attempt.write(bits.hint("rebalance", "facet").sortWithinPartitions("facet", "value", "bucket"), BITMAPS, "facet")


def add_listing(rows: DataFrame, root: str, run_id: str, slice_rows: int = SLICE_ROWS) -> None:
    """Add a run's postings to the listing under ``root``; a repeated run takes the place of its earlier attempt.

    ``rows`` has the facets, ``posting_date``, ``fingerprint`` and ``ingest_seq``, and any other
    columns but those the listing adds (``_OWN``). It is read three times, so it should be a
    stored table. A null facet is no value: no test finds it.
    """
    attempt = Attempt(rows.sparkSession, root, run_id, "listing")
    attempt.removed = [*attempt.base.of(LISTING, run_id), *attempt.base.of(BITMAPS, run_id)]
    _write(attempt, rows, slice_rows)
    attempt.commit()


def compact(spark: SparkSession, root: str, run_id: str = "compacted", slice_rows: int = SLICE_ROWS) -> None:
    """Merge all parts of the listing into one."""
    attempt = Attempt(spark, root, run_id, "compact listing")
    parts = attempt.base.of(LISTING)
    if len(parts) < 2:
        return
    attempt.removed = [*parts, *attempt.base.of(BITMAPS)]
    _write(attempt, _rows(spark, root, [p.path(root) for p in parts]).drop(*_OWN), slice_rows)
    attempt.commit()


def _rows(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    return spark.read.option("basePath", f"{root}/{LISTING}").parquet(*paths)


class Listing:
    """One version of a stored listing. Tests are facet=value; ``None`` or "All" leaves a facet open."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None) -> None:
        now = snapshot(spark, root, version)
        self.spark, self.root = spark, root
        self.parts: dict[str, Part] = {p.attempt: p for p in now.of(LISTING)}
        self.bitmaps = read_parts(spark, root, now.of(BITMAPS), _BITMAP)

    def _found(self, tests: dict[str, str | None]) -> DataFrame:
        """(attempt, bucket, bits, n): the rows that pass all tests, for buckets that have any."""
        wanted = {f: v for f, v in tests.items() if v is not None and v != "All"}
        if unknown := set(wanted) - set(FACETS):
            raise ValueError(f"not facets: {sorted(unknown)}")
        if not wanted:
            return self.bitmaps.where(F.col("facet") == _ANY).select("attempt", "bucket", "bits", "n")
        listed = self.bitmaps.where(reduce(or_, [(F.col("facet") == f) & (F.col("value") == v) for f, v in wanted.items()]))
        both = listed.groupBy("attempt", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("_passed"))
        found = both.where(F.col("_passed") == len(wanted)).select("attempt", "bucket", "bits", F.bitmap_count("bits").alias("n"))
        return found.where("n > 0")

    def count(self, **tests: str | None) -> DataFrame:
        """One row: how many postings pass the tests."""
        return self._found(tests).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    def facet_counts(self, **tests: str | None) -> DataFrame:
        """(facet, value, n): for every value, the postings that pass the tests and have it; none of 0."""
        values = self.bitmaps.where(F.col("facet") != _ANY)
        if all(v is None or v == "All" for v in tests.values()):
            return values.groupBy("facet", "value").agg(F.sum("n").alias("n"))
        found = self._found(tests).select("attempt", "bucket", F.col("bits").alias("_bits"))
        pairs = values.join(found, ["attempt", "bucket"]).select(
            "facet", "value", "attempt", "bucket", F.explode(F.array("bits", "_bits")).alias("bits"))
        both = pairs.groupBy("facet", "value", "attempt", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
        return both.groupBy("facet", "value").agg(F.sum("n").alias("n")).where("n > 0")

    def page(self, k: int = 100, **tests: str | None) -> DataFrame:
        """The k newest postings that pass the tests, with their ``rank``; only their slices are opened.

        Of each part the first buckets that hold k such rows are enough. A bucket in the list has a row, so at
        most k numbers of a part reach the driver.
        """
        order = Window.partitionBy("attempt").orderBy("bucket")
        first = self._found(tests).select("attempt", "bucket", "n").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        last: dict[str, int] = {}
        slices: dict[str, None] = {}
        for row in first.withColumn("_before", before).where(F.col("_before") < k).orderBy("attempt", "bucket").collect():
            last[row["attempt"]] = row["bucket"]
            slices[f"{self.parts[row['attempt']].path(self.root)}/slice={row['bucket'] >> (_SLICE - _BUCKET)}"] = None
        if not slices:
            whole = [p.path(self.root) for p in self.parts.values()]
            if not whole:
                raise ValueError(f"{self.root} holds no listing")
            return newest(_rows(self.spark, self.root, whole).where("false").drop(*_OWN), k)
        near = reduce(or_, [(F.col("attempt") == a) & (F.col("row_id") < (b + 1) << _BUCKET) for a, b in last.items()])
        rows = facet_filter(_rows(self.spark, self.root, list(slices)).where(near), **tests)
        return newest(rows.drop(*_OWN), k)
