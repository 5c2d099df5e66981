"""Exports. Every writer leaves a folder of part files, written by the tasks themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirescope.operators.analytics import newest


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that a row fits one CSV line."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def without_zone(df: DataFrame) -> DataFrame:
    """Timestamps as zone-less wall-clock time, for tools that know no time zones."""
    return df.withColumns(
        {f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
    )


_CSV = {"header": True, "quote": '"', "escape": '"'}


def export_csv(df: DataFrame, path: str) -> str:
    flat(df).write.mode("overwrite").options(**_CSV).csv(path)
    return path


def read_csv(spark, path: str, schema: T.StructType) -> DataFrame:
    """Reads back what :func:`export_csv` wrote; texts may hold line breaks.

    CSV does not tell an empty text from a missing one: both come back as null.
    """
    return spark.read.options(**_CSV, multiLine=True).schema(schema).csv(path)


def export_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def export_bundle(sheets: dict[str, DataFrame], path: str) -> dict[str, str]:
    """One folder per sheet; a sheet without rows is left out."""
    written = {}
    for name, df in sheets.items():
        if not df.isEmpty():
            target = f"{path}/{name}"
            without_zone(df).write.mode("overwrite").parquet(target)
            written[name] = target
    return written


def report_rows(analytics: DataFrame, postings: DataFrame) -> DataFrame:
    """The report as (section, rank, text): summary, skills, countries, companies, titles, samples."""
    limits = {
        "summary": 5, "top_skills": 20, "country_distribution": 15,
        "company_hiring": 10, "title_distribution": 10,
    }
    kept = F.coalesce(
        *[F.when(F.col("section") == s, F.col("rank") <= k) for s, k in limits.items()], F.lit(False)
    )
    number = F.when(
        F.col("value") == F.floor("value"), F.col("value").cast("bigint").cast("string")
    ).otherwise(F.col("value").cast("string"))
    lines = analytics.where(kept).select(
        "section", "rank", F.concat_ws(": ", F.col("key"), number).alias("text")
    )
    samples = newest(postings, 10).select(
        F.lit("sample_postings").alias("section"),
        "rank",
        F.concat_ws(" | ", "title", "company", "country", "remote_type", "source").alias("text"),
    )
    return lines.unionByName(samples)


def export_report(report: DataFrame, path: str) -> str:
    """The ordered report as text lines. A report has a fixed, small number of rows."""
    ordered = report.orderBy("section", "rank").coalesce(1)
    ordered.select(F.concat_ws(" ", F.concat(F.lit("["), "section", F.lit("]")), "rank", "text").alias("value")).write.mode(
        "overwrite"
    ).text(path)
    return path


def export_all(
    postings: DataFrame, analytics: DataFrame, prefix: str, root: str, recommendations: DataFrame | None = None
) -> dict[str, str]:
    """Every export of a run under ``root``, names carrying the run's prefix."""
    paths = {
        "jobs_csv": export_csv(postings, f"{root}/jobs_{prefix}_csv"),
        "jobs_json": export_json(postings, f"{root}/jobs_{prefix}_json"),
        "analytics_json": export_json(analytics, f"{root}/analytics_{prefix}"),
        "report": export_report(report_rows(analytics, postings), f"{root}/report_{prefix}"),
    }

    def section(name: str) -> DataFrame:
        return analytics.where(F.col("section") == name)

    sheets = {
        "Jobs": postings,
        "Analytics_Summary": section("summary"),
        "Top_Skills": section("top_skills"),
        "Country_Distribution": section("country_distribution"),
    }
    if recommendations is not None:
        sheets["Recommendations"] = recommendations
    bundle = export_bundle(sheets, f"{root}/full_report_{prefix}")
    return {**paths, **{f"sheet_{name}": path for name, path in bundle.items()}}
