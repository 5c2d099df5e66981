"""Market statistics over postings. Empty input gives empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hirescope import fixed_values as fv
from hirescope.config import Profile
from hirescope.functions.numbers import round_even
from hirescope.functions.stats import count_by, int_summary, top
from hirescope.functions.text import lookup
from hirescope.operators.skills import skill_frequency, skills_by_country


def summary_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, companies, countries, share of remote postings, postings with visa."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    share = F.count_if(F.col("remote_type") == "remote") / F.count(F.lit(1)) * 100
    return df.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        distinct("company").alias("unique_companies"),
        distinct("country").alias("unique_locations"),
        round_even(share, 1).alias("remote_percentage"),
        F.count_if("visa_sponsorship").alias("visa_sponsorship_count"),
    )


def top_skills(names: DataFrame, k: int = 20) -> DataFrame:
    return skill_frequency(names, k)


def country_distribution(df: DataFrame, k: int = 15) -> DataFrame:
    return top(count_by(df, "country"), k, "n", "country")


def remote_trends(df: DataFrame) -> DataFrame:
    return count_by(df, "remote_type")


def company_hiring(df: DataFrame, k: int = 20) -> DataFrame:
    return top(count_by(df, "company"), k, "n", "company")


def title_distribution(df: DataFrame, k: int = 15) -> DataFrame:
    column = "normalized_title" if "normalized_title" in df.columns else "title"
    return top(count_by(df, column), k, "n", column)


def experience_distribution(df: DataFrame) -> DataFrame:
    return count_by(df, "experience_level")


def source_distribution(df: DataFrame) -> DataFrame:
    return count_by(df, "source")


def role_breakdown(df: DataFrame) -> DataFrame:
    return count_by(df, "role_category")


def kpi(df: DataFrame) -> DataFrame:
    return summary_stats(df).select(
        "total_jobs", "unique_companies", "unique_locations", "visa_sponsorship_count"
    )


def salary_analysis(df: DataFrame, *group: str) -> DataFrame:
    """Mean, median, min and max of both salary bounds; pass a column to split by it."""
    bounds = F.array(
        F.struct(F.lit("min_salary").alias("bound"), F.col("salary_min").alias("amount")),
        F.struct(F.lit("max_salary").alias("bound"), F.col("salary_max").alias("amount")),
    )
    long = df.select(*group, F.inline(bounds))
    return salary_rows(int_summary(long, ["bound", *group], "amount"), "bound", *group)


def salary_rows(stats: DataFrame, *group: str) -> DataFrame:
    return stats.select(
        *group,
        round_even(F.col("mean")).alias("mean"),
        round_even(F.col("median")).alias("median"),
        F.col("smallest").alias("min"),
        F.col("largest").alias("max"),
    )


def hiring_over_time(df: DataFrame) -> DataFrame:
    """Postings per week (from Monday), role and country, and the change on the week before.

    The change is null if the week before has no posting of that role and country.
    """
    weekly = (
        df.where(F.col("posting_date").isNotNull())
        .groupBy(F.date_trunc("week", "posting_date").alias("week"), "role_category", "country")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    series = Window.partitionBy("role_category", "country").orderBy("week")
    adjacent = F.lag("week").over(series) == F.col("week") - F.expr("INTERVAL 7 DAYS")
    return weekly.withColumn("change", F.when(adjacent, F.col("n") - F.lag("n").over(series)))


def skill_gap(frequency: DataFrame, profile: Profile) -> DataFrame:
    """Market skills against a profile, one row per skill in the frequency table.

    ``market_rank`` orders all skills and ``missing_rank`` the missing ones (report
    the first 20 and 10). ``skill_coverage`` divides the number of profile skills
    by the number of market skills; ``matched_coverage`` counts true overlap.
    """
    # The table holds at most one row per taxonomy term, so one window is fine.
    order = [F.desc("n"), F.asc("skill")]
    covered = F.lower("skill").isin(*profile.skill_set) if profile.skill_set else F.lit(False)
    everything = Window.partitionBy()
    size = F.count(F.lit(1)).over(everything)
    return (
        frequency.withColumn("status", F.when(covered, "covered").otherwise("missing"))
        .withColumn("market_rank", F.row_number().over(Window.partitionBy().orderBy(*order)))
        .withColumn("_rank", F.row_number().over(Window.partitionBy("status").orderBy(*order)))
        .withColumns(
            {
                "missing_rank": F.when(F.col("status") == "missing", F.col("_rank")),
                "skill_coverage": round_even(F.lit(len(profile.skills)) / size * 100, 1),
                "matched_coverage": round_even(
                    F.count_if(F.col("status") == "covered").over(everything) / size * 100, 1
                ),
            }
        )
        .drop("_rank")
    )


def learning_recs(gap: DataFrame, k: int = 5) -> DataFrame:
    """Advice for the k most wanted missing skills; skills without advice are left out."""
    return (
        gap.where(F.col("missing_rank") <= k)
        .withColumn("advice", lookup(F.col("skill"), fv.LEARNING_PATHS))
        .where(F.col("advice").isNotNull())
        .select("missing_rank", "skill", F.concat_ws(": ", "skill", "advice").alias("recommendation"))
    )


SECTIONS = (
    # section, column, how many values to keep (None: all)
    ("country_distribution", "country", 15),
    ("remote_trends", "remote_type", None),
    ("company_hiring", "company", 20),
    ("title_distribution", "normalized_title", 15),
    ("experience_distribution", "experience_level", None),
    ("source_distribution", "source", None),
)


def value_counts(df: DataFrame) -> DataFrame:
    """(section, key, n) for every single-column count, in one pass by grouping sets."""
    columns = [c for _, c, _ in SECTIONS]
    grouped = df.groupingSets([[c] for c in columns], *columns).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid")
    )
    width = len(columns)
    section, key = None, None
    for i, (name, column, _) in enumerate(SECTIONS):
        # Every column is aggregated away except the one of this section.
        only_this = F.col("_gid") == (1 << width) - 1 - (1 << (width - 1 - i))
        section = F.when(only_this, F.lit(name)) if section is None else section.when(only_this, F.lit(name))
        key = F.when(only_this, F.col(column)) if key is None else key.when(only_this, F.col(column))
    return grouped.select(section.alias("section"), key.alias("key"), "n").where(F.col("key").isNotNull())


def analytics_long(df: DataFrame, names: DataFrame) -> DataFrame:
    """All statistics as (section, rank, key, value): one frame to store, chart or export."""
    return long_report(summary_stats(df), value_counts(df), top_skills(names), skills_by_country(names), salary_analysis(df))


def long_report(summary: DataFrame, values: DataFrame, skills: DataFrame, by_country: DataFrame, salaries: DataFrame) -> DataFrame:
    """The parts of the report in one frame; ``values`` (section, key, n) are ranked here."""
    limits = F.create_map(*[F.lit(x) for s, _, k in SECTIONS if k for x in (s, k)])
    by_section = Window.partitionBy("section").orderBy(F.desc("n"), F.asc("key"))
    limited = [s for s, _, k in SECTIONS if k]
    largest = max(k for _, _, k in SECTIONS if k)
    ranked = values.withColumn("rank", F.row_number().over(by_section))
    # The constant bound lets Spark prune each task to that many rows per section.
    short = ranked.where((F.col("rank") <= largest) & F.col("section").isin(*limited))
    short = short.where(F.col("rank") <= F.try_element_at(limits, F.col("section")))
    full = ranked.where(~F.col("section").isin(*limited))
    counts = short.unionByName(full).select("section", "rank", "key", F.col("n").cast("double").alias("value"))

    by_rank = Window.partitionBy().orderBy(F.desc("n"), F.asc("skill"))
    skills = skills.select(
        F.lit("top_skills").alias("section"), F.row_number().over(by_rank).alias("rank"),
        F.col("skill").alias("key"), F.col("n").cast("double").alias("value"),
    )
    by_country = by_country.select(
        F.lit("skill_by_country").alias("section"), "rank",
        F.concat_ws(" / ", "country", "skill").alias("key"), F.col("n").cast("double").alias("value"),
    )
    return (
        _as_rows(summary, "summary", [])
        .unionByName(counts)
        .unionByName(skills)
        .unionByName(by_country)
        .unionByName(_as_rows(salaries, "salary_analysis", ["bound"]))
    )


def _as_rows(wide: DataFrame, section: str, labels: list[str]) -> DataFrame:
    """Numeric columns of a small frame as (section, rank, key, value) rows."""
    values = [c for c in wide.columns if c not in labels]
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("rank"),
                F.concat_ws(" ", *labels, F.lit(c)).alias("key"),
                F.col(c).cast("double").alias("value"),
            )
            for i, c in enumerate(values, 1)
        ]
    )
    return wide.select(F.lit(section).alias("section"), F.inline(entries))


def latest_runs(runs: DataFrame, k: int = 10) -> DataFrame:
    return (
        runs.select("run_id", "status", "jobs_found", "jobs_validated", "started_at")
        .orderBy(F.desc("started_at"), F.asc("run_id"))
        .limit(k)
    )


def newest_first() -> list[Column]:
    """Order of a listing; undated postings come last."""
    return [F.desc_nulls_last("posting_date"), F.asc("fingerprint"), F.asc("ingest_seq")]


def newest(df: DataFrame, k: int) -> DataFrame:
    """The k newest postings with their ``rank``."""
    order = newest_first()
    # Only the k rows that are left reach the window.
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order)))


def listing_page(df: DataFrame, k: int = 100) -> DataFrame:
    """The newest postings in display form."""
    return newest(df, k).select(
        "title", "company", "role_category", "country", "remote_type",
        "experience_level", "source", "visa_sponsorship",
    )
