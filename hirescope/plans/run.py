"""One complete run: landing -> discovery -> parsing -> validation -> skills -> store, reports."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hirescope.catalog import project_catalog
from hirescope.config import Config, Profile
from hirescope.operators import analytics as an
from hirescope.operators import recommend as rec
from hirescope.operators import store
from hirescope.operators.export import export_all
from hirescope.operators.normalize import parse_postings
from hirescope.operators.skills import explode_names, extract_skills, skill_demand
from hirescope.operators.validate import accepted, validate_postings
from hirescope.plans.discovery import discover
from hirescope.plans.rejects import rejects
from hirescope.session import materialize
from hirescope.sources import map_landing, unreadable_payloads, usable_postings


@dataclass
class RunResult:
    run_id: str
    postings: DataFrame
    rejected: DataFrame
    analytics: DataFrame
    matches: DataFrame
    projects: DataFrame
    exports: dict[str, str]
    counts: dict[str, int]


def with_skills(valid: DataFrame, cfg: Config, extractor=extract_skills) -> DataFrame:
    """Valid postings with ``skills`` and ``skill_names``. ``extractor`` can be replaced."""
    return extractor(valid, cfg).withColumn("skill_names", F.transform("skills", lambda s: s["name"]))


def check_landed(mapped: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Postings found in the written ``mapped`` landing, those of them that parse, with their verdict, and
    the counts of a run; the counts are taken while the tables are written.

    Found is counted before parsing; rows that cannot be parsed count as rejected.
    """
    n_found, n_valid = Observation(), Observation()
    found = discover(usable_postings(mapped), cfg, written=True).observe(n_found, F.count(F.lit(1)).alias("n"))
    found = materialize(found, "found")
    checked = validate_postings(parse_postings(found, cfg), cfg).observe(n_valid, F.count_if("is_valid").alias("n"))
    checked = materialize(checked, "validated")
    n, valid = n_found.get["n"], n_valid.get["n"]
    return found, checked, {"found": n, "validated": valid, "rejected": n - valid}


def run(
    landing: DataFrame, root: str, cfg: Config, profile: Profile = Profile(), run_id: str | None = None,
    extractor=extract_skills,
) -> RunResult:
    """Everything from landed payloads to stored tables, reports and a run-log row.

    Validated postings are written once, with their skills; analytics, matching
    and exports all read that table, so no text is scanned twice.
    """
    spark = landing.sparkSession
    run_id = run_id or uuid.uuid4().hex[:8]
    started = datetime.now(timezone.utc)
    counts = {"found": 0, "validated": 0, "rejected": 0}
    try:
        mapped = materialize(map_landing(landing, cfg), "mapped")
        found, checked, counts = check_landed(mapped, cfg)
        postings = materialize(with_skills(accepted(checked), cfg, extractor), "postings")
        all_rejects = materialize(rejects(unreadable_payloads(mapped), found, checked), "rejects")
        store.store_run(postings, root, run_id, cfg, all_rejects)
        names = explode_names(postings, "fingerprint", "country")
        report = materialize(an.analytics_long(postings, names), "analytics")
        matches = rec.rank_matches(rec.match_jobs(postings, profile), 20)
        projects = rec.recommend_projects(project_catalog(spark), postings, skill_demand(names), profile)
        matches = store.write_matches(matches, root, run_id)
        exports = export_all(postings, report, run_id, f"{root}/reports", matches)
        log(spark, root, run_id, started, "completed", counts, {"exports": exports})
        return RunResult(run_id, postings, all_rejects, report, matches, projects, exports, counts)
    except Exception as error:
        log(spark, root, run_id, started, "failed", counts, {"error": str(error)})
        raise


def log(spark, root: str, run_id: str, started: datetime, status: str, counts: dict, metadata: dict) -> None:
    row = store.run_log_row(
        spark, run_id, started, datetime.now(timezone.utc), status,
        counts["found"], counts["validated"], counts["rejected"], metadata,
    )
    store.append_run(row, f"{root}/runs")
