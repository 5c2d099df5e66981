"""The market report kept up to date run by run, without reading earlier postings again.

Every figure of the report follows from how often each value occurs: of a company,
country, title and so on, of a salary, of a skill, and of a skill in a country. A run adds its
tally of values to a log of changes that is merged by sums
(:mod:`hirescope.streaming.logs`). Sums are exact and can be taken back: distinct values are
those that occur more than zero times, and the median is walked over counts of
values. A run that is repeated adds the difference to its own earlier tally, which
is kept; a run that is withdrawn adds its negative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirescope.functions.numbers import round_even
from hirescope.functions.stats import counted_summary, top, top_per_group
from hirescope.operators import analytics as an
from hirescope.operators.versions import Attempt, read_parts
from hirescope.schemas import LONG, STRING, struct
from hirescope.session import materialize
from hirescope.streaming import logs

#: ``section`` says of what, ``key`` (and for skills in countries ``sub``) which value, ``n`` how often.
TALLY = struct(section=STRING, key=STRING, sub=STRING, n=LONG)


def tally(postings: DataFrame, names: DataFrame) -> DataFrame:
    """How often each value occurs in ``postings``, and each skill in their exploded ``names`` (country, skill)."""
    none = F.lit(None).cast("string").alias("sub")
    values = an.value_counts(postings).select("section", "key", none, "n")
    rows = postings.agg(F.count(F.lit(1)).alias("rows"), F.count_if("visa_sponsorship").alias("visa"))
    rows = rows.select(F.lit("total").alias("section"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("key"), none, F.col(c).alias("n")) for c in ("rows", "visa")])))
    bounds = F.array(*[F.struct(F.lit(b).alias("section"), F.col(c).cast("string").alias("key"))
                       for b, c in (("min_salary", "salary_min"), ("max_salary", "salary_max"))])
    pay = postings.select(F.inline(bounds)).where("key IS NOT NULL").groupBy("section", "key").agg(F.count(F.lit(1)).alias("n"))
    by_country = names.groupBy(F.coalesce("country", F.lit("Unknown")).alias("key"), F.col("skill").alias("sub")).agg(F.count(F.lit(1)).alias("n"))
    return (values.unionByName(rows).unionByName(pay.select("section", "key", none, "n"))
            .unionByName(by_country.select(F.lit("skill").alias("section"), "key", "sub", "n")))


def summed(changes: DataFrame) -> DataFrame:
    """Changes added up; values that do not occur any more are left out."""
    return changes.groupBy("section", "key", "sub").agg(F.sum("n").alias("n")).where("n <> 0")


def _change(spark: SparkSession, root: str, run_id: str, operation: str, new: DataFrame | None) -> None:
    attempt = Attempt(spark, root, run_id, operation)
    attempt.removed = attempt.base.of("tallies", run_id)
    before = read_parts(spark, root, attempt.removed, TALLY).withColumn("n", -F.col("n"))
    if new is None:
        change = before
    else:
        change = attempt.write(new, "tallies").unionByName(before)
    attempt.write(summed(change), "changes")
    logs.merge(spark, root, "changes", TALLY, summed, now=attempt.commit())


def add_run(root: str, run_id: str, postings: DataFrame, names: DataFrame) -> None:
    """Count a run in, in place of what it counted before."""
    _change(postings.sparkSession, root, run_id, "tally", tally(postings, names))


def withdraw_run(spark: SparkSession, root: str, run_id: str) -> None:
    """Take a run out of the report."""
    _change(spark, root, run_id, "withdraw", None)


def report(spark: SparkSession, root: str) -> DataFrame:
    """The rows of :func:`hirescope.operators.analytics.analytics_long` over all runs that are counted in."""
    now = materialize(summed(logs.live(spark, root, "changes", TALLY)), "tallies")

    def values(section: str) -> DataFrame:
        return now.where(F.col("section") == section).select("key", "sub", "n")

    def times(section: str, key: str):
        return F.coalesce(F.sum(F.when((F.col("section") == section) & (F.col("key") == key), F.col("n"))), F.lit(0))

    rows = times("total", "rows")
    summary = now.agg(
        rows.alias("total_jobs"),
        F.count_if(F.col("section") == "company_hiring").alias("unique_companies"),
        F.count_if(F.col("section") == "country_distribution").alias("unique_locations"),
        round_even(times("remote_trends", "remote") / F.nullif(rows, F.lit(0)) * 100, 1).alias("remote_percentage"),
        times("total", "visa").alias("visa_sponsorship_count"))
    by_country = values("skill").select(F.col("key").alias("country"), F.col("sub").alias("skill"), "n")
    skills = by_country.groupBy("skill").agg(F.sum("n").alias("n"))
    pay = now.where(F.col("section").isin("min_salary", "max_salary")).select(
        F.col("section").alias("bound"), F.col("key").cast("int").alias("_v"), F.col("n").alias("_n"))
    return an.long_report(
        summary, now.where(F.col("section").isin(*[s for s, _, _ in an.SECTIONS])).select("section", "key", "n"),
        top(skills, 20, "n", "skill"), top_per_group(by_country, ["country"], 20, [F.desc("n"), F.asc("skill")]),
        an.salary_rows(counted_summary(pay, ["bound"]), "bound"))
