"""Queries: skills, statistics, recommendations, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirescope.catalog import CATALOG, project_catalog
from hirescope.config import Profile
from hirescope.operators import analytics as an
from hirescope.operators import answers, export, incremental, normalize, skills, store, validate
from hirescope.operators import recommend as rec
from hirescope.plans.discovery import discover
from hirescope.schemas import RUN_LOG, conform
from hirescope.session import scratch_path
from workloads import inputs as I
from workloads import oracle as O
from workloads.registry import joined, register, seconds

CFG = I.CFG
PARSED = O.parsed("raw")


def parsed(spark, sf) -> DataFrame:
    return normalize.parse_postings(I.texts(spark, sf), CFG)


def names(spark, sf, *keep: str) -> DataFrame:
    """Exploded skill names of the parsed postings."""
    return skills.explode_names(skills.extract_skill_names(parsed(spark, sf), CFG), *keep)


# --- skills ---------------------------------------------------------------------------

@register(
    "extract_skills",
    O.query(
        O.RAW, *O.skills("raw"),
        "SELECT ingest_seq, string_agg(skill || ':' || n_hits, '|' ORDER BY n_hits DESC, skill) AS skills, count(*) AS n_skills "
        "FROM hits GROUP BY ingest_seq UNION ALL SELECT ingest_seq, '', 0 FROM raw WHERE ingest_seq NOT IN (SELECT ingest_seq FROM hits)",
    ),
)
def _(spark, sf):
    found = skills.extract_skills(I.texts(spark, sf), CFG)
    labels = F.transform("skills", lambda s: F.concat_ws(":", s["name"], s["count"].cast("string")))
    return found.select("ingest_seq", joined(labels, "skills"), F.size("skills").cast("bigint").alias("n_skills"))


@register("skill_required", O.query(O.RAW, *O.skills("raw"), "SELECT ingest_seq, skill, is_required FROM hits"))
def _(spark, sf):
    found = skills.explode_hits(skills.extract_skills(I.texts(spark, sf), CFG), "ingest_seq")
    return found.select("ingest_seq", "skill", "is_required")


@register(
    "skill_category",
    O.query(O.RAW, *O.skills("raw"), "SELECT category, skill, count(*) AS n FROM hits GROUP BY category, skill"),
)
def _(spark, sf):
    found = skills.explode_hits(skills.extract_skills(I.texts(spark, sf), CFG), "ingest_seq")
    return found.groupBy("category", "skill").agg(F.count(F.lit(1)).alias("n"))


_NAMES = [O.RAW, PARSED, *O.skills("parsed")]
_FREQ = "freq AS (SELECT skill, count(*) AS n FROM hits GROUP BY skill ORDER BY n DESC, skill LIMIT 50)"


@register("skill_frequency", O.query(*_NAMES, _FREQ, "SELECT skill, n FROM freq"))
def _(spark, sf):
    return skills.skill_frequency(names(spark, sf))


@register(
    "skills_by_country",
    O.query(
        *_NAMES, "SELECT country, skill, count(*) AS n, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, skill) AS rank "
        "FROM hits GROUP BY country, skill QUALIFY rank <= 20",
    ),
)
def _(spark, sf):
    return skills.skills_by_country(names(spark, sf, "country"))


@register(
    "skills_by_industry",
    O.query(
        *_NAMES, "j AS (SELECT coalesce(c_mktsegment, 'Unknown') AS industry, skill FROM hits LEFT JOIN customer ON c_custkey = company_id)",
        "SELECT industry, skill, count(*) AS n, row_number() OVER (PARTITION BY industry ORDER BY count(*) DESC, skill) AS rank "
        "FROM j GROUP BY industry, skill QUALIFY rank <= 15",
    ),
)
def _(spark, sf):
    return skills.skills_by_industry(names(spark, sf, "company_id"), I.companies(spark, sf))


@register(
    "emerging_skills",
    O.query(
        *_NAMES, _FREQ, "SELECT skill, n, CAST(n AS DOUBLE) / (SELECT count(*) FROM parsed) AS share FROM freq "
        "WHERE CAST(n AS DOUBLE) / (SELECT count(*) FROM parsed) >= 0.1",
    ),
)
def _(spark, sf):
    return skills.emerging_skills(names(spark, sf), parsed(spark, sf))


@register(
    "skill_totals",
    O.query(
        O.RAW, *O.skills("raw", text="title"),
        "SELECT skill, sum(n_hits)::BIGINT AS n, category FROM hits GROUP BY skill, category ORDER BY n DESC, skill LIMIT 20",
    ),
)
def _(spark, sf):
    return skills.skill_totals(I.postings(spark, sf), CFG)


@register(
    "job_skills_bridge",
    O.query(
        *_NAMES, "SELECT fingerprint, skill, category, is_required, n_hits::INT AS count FROM hits "
        "QUALIFY row_number() OVER (PARTITION BY fingerprint, skill ORDER BY ingest_seq) = 1",
    ),
)
def _(spark, sf):
    return skills.job_skills_bridge(parsed(spark, sf), CFG)


@register(
    "skill_dimension",
    O.query(
        *_NAMES, "SELECT skill, category, count(DISTINCT fingerprint) AS frequency FROM hits GROUP BY skill, category",
    ),
)
def _(spark, sf):
    return skills.skill_dimension(skills.job_skills_bridge(parsed(spark, sf), CFG))


_TEXT_SQL = "title || ' ' || coalesce(description, '')"

# Landed answers: good object, prose around it, bare list, broken, empty list, nameless entry.
_ANSWER = """CASE ingest_seq % 7
    WHEN 0 THEN '{"skills":[{"name":"Salesforce","category":"business","is_required":true},{"name":"CSAT"},{"name":" csat "}]}'
    WHEN 1 THEN 'Sure! Here it is: {"skills":[{"name":"Python","is_required":false},"Juggling"]} Hope it helps.'
    WHEN 2 THEN '["SQL", {"name":"dbt","category":"","is_required":1}]'
    WHEN 3 THEN 'no json {broken'
    WHEN 4 THEN '{"skills":[]}'
    WHEN 5 THEN '{"skills":[{"category":"technical"}]}'
    ELSE '{"note":"none"}' END"""
_EXPECTED = """CASE ingest_seq % 7
    WHEN 0 THEN 'salesforce:business:true|csat:cx_metric:false'
    WHEN 1 THEN 'python:programming:false|juggling:soft:false'
    WHEN 2 THEN 'sql:database:false|dbt:transformation:true' END"""


@register(
    "skills_from_llm_json",
    O.query(
        O.RAW,
        f"given AS (SELECT md5({O.strip(_TEXT_SQL)}) AS h, {_EXPECTED} AS e, ingest_seq FROM raw)",
        "ans AS (SELECT h, arg_min(e, ingest_seq) AS e FROM given WHERE e IS NOT NULL GROUP BY h)",
        *O.skills("raw"),
        f"hh AS (SELECT *, md5({O.strip(_TEXT_SQL)}) AS h FROM raw)",
        "own AS (SELECT ingest_seq, string_agg(skill || ':' || category || ':' || is_required, '|' ORDER BY n_hits DESC, skill) AS s FROM hits GROUP BY ingest_seq)",
        "SELECT hh.ingest_seq, coalesce(ans.e, own.s, '') AS skills, ans.e IS NOT NULL AS from_answer FROM hh LEFT JOIN ans USING (h) LEFT JOIN own USING (ingest_seq)",
    ).replace("WITH RECURSIVE", "WITH"),
)
def _(spark, sf):
    posts = I.texts(spark, sf).withColumn("text_hash", answers.text_hash())
    landed = posts.select("text_hash", F.expr(_ANSWER).alias("content"), F.col("ingest_seq").alias("answer_seq"))
    merged = answers.skills_from_answers(skills.extract_skills(posts, CFG), landed, CFG)
    labels = F.transform("skills", lambda s: F.concat_ws(":", s["name"], s["category"], s["is_required"].cast("string")))
    return merged.select("ingest_seq", joined(labels, "skills"), "from_answer")


# --- statistics --------------------------------------------------------------------------

_ROLE_OF = f"{O.ROLE} AS role"


@register(
    "summary_stats",
    O.query(
        O.RAW, PARSED, "SELECT count(*) AS total_jobs, count(DISTINCT company) AS unique_companies, count(DISTINCT country) AS unique_locations, "
        "round_even(CAST(count(*) FILTER (remote_type = 'remote') AS DOUBLE) / count(*) * 100, 1) AS remote_percentage, "
        "count(*) FILTER (visa_sponsorship) AS visa_sponsorship_count FROM parsed",
    ),
)
def _(spark, sf):
    return an.summary_stats(parsed(spark, sf))


@register("top_skills", O.query(*_NAMES, _FREQ, "SELECT skill, n FROM freq ORDER BY n DESC, skill LIMIT 20"))
def _(spark, sf):
    return an.top_skills(names(spark, sf))


def _counts(column: str, limit: int | None = None) -> str:
    tail = f" ORDER BY n DESC, {column} LIMIT {limit}" if limit else ""
    return O.query(O.RAW, PARSED, f"SELECT {column}, count(*) AS n FROM parsed WHERE {column} IS NOT NULL GROUP BY {column}{tail}")


@register("country_distribution", _counts("country", 15))
def _(spark, sf):
    return an.country_distribution(parsed(spark, sf))


@register("remote_trends", _counts("remote_type"))
def _(spark, sf):
    return an.remote_trends(parsed(spark, sf))


@register("company_hiring", _counts("company", 20))
def _(spark, sf):
    return an.company_hiring(parsed(spark, sf))


@register("title_distribution", _counts("normalized_title", 15))
def _(spark, sf):
    return an.title_distribution(parsed(spark, sf))


@register("experience_distribution", _counts("experience_level"))
def _(spark, sf):
    return an.experience_distribution(parsed(spark, sf))


@register("source_distribution", _counts("source"))
def _(spark, sf):
    return an.source_distribution(parsed(spark, sf))


@register(
    "role_breakdown",
    O.query(O.RAW, PARSED, f"SELECT role AS role_category, count(*) AS n FROM (SELECT {_ROLE_OF} FROM parsed) WHERE role IS NOT NULL GROUP BY role"),
)
def _(spark, sf):
    from hirescope.operators.filters import classify_role

    return an.role_breakdown(classify_role(parsed(spark, sf), CFG))


def _salary(group: str = "") -> str:
    extra = f", {group}" if group else ""
    parts = [
        f"SELECT '{bound}' AS bound{extra}, round_even(avg({c}), 0) AS mean, round_even(median({c}), 0) AS median, min({c}) AS min, max({c}) AS max "
        f"FROM parsed WHERE {c} IS NOT NULL" + (f" GROUP BY {group}" if group else "")
        for bound, c in (("min_salary", "salary_min"), ("max_salary", "salary_max"))
    ]
    return " UNION ALL ".join(parts)


@register("salary_analysis", O.query(O.RAW, PARSED, _salary()).replace("WITH RECURSIVE", "WITH"))
def _(spark, sf):
    return an.salary_analysis(parsed(spark, sf))


@register("salary_by_currency", O.query(O.RAW, PARSED, _salary("salary_currency")).replace("WITH RECURSIVE", "WITH"))
def _(spark, sf):
    return an.salary_analysis(parsed(spark, sf), "salary_currency")


@register(
    "kpi",
    O.query(
        O.RAW, PARSED, "SELECT count(*) AS total_jobs, count(DISTINCT company) AS unique_companies, count(DISTINCT country) AS unique_locations, "
        "count(*) FILTER (visa_sponsorship) AS visa_sponsorship_count FROM parsed WHERE remote_type = 'hybrid'",
    ),
)
def _(spark, sf):
    from hirescope.operators.filters import facet_filter

    return an.kpi(facet_filter(parsed(spark, sf), country="All", remote_type="hybrid"))


_WEEKS = (
    f"w AS (SELECT date_trunc('week', posting_date) AS week, {O.ROLE} AS role_category, country, count(*) AS n FROM parsed "
    "WHERE posting_date IS NOT NULL GROUP BY ALL)"
)


@register(
    "hiring_over_time",
    O.query(
        O.RAW, PARSED, _WEEKS,
        "SELECT strftime(a.week, '%Y-%m-%d %H:%M:%S') AS week, a.role_category, a.country, a.n, a.n - b.n AS change FROM w a LEFT JOIN w b "
        "ON b.week = a.week - INTERVAL 7 DAY AND b.role_category IS NOT DISTINCT FROM a.role_category AND b.country = a.country",
    ),
)
def _(spark, sf):
    from hirescope.operators.filters import classify_role

    weekly = an.hiring_over_time(classify_role(parsed(spark, sf), CFG))
    return weekly.withColumn("week", seconds("week"))


_GAP = (
    "gap AS (SELECT skill, n, CASE WHEN skill IN ('sql', 'excel', 'python', 'tableau', 'dbt') THEN 'covered' ELSE 'missing' END AS status FROM freq)"
)


@register(
    "skill_gap",
    O.query(
        *_NAMES, _FREQ, _GAP,
        "SELECT skill, n, status, row_number() OVER (ORDER BY n DESC, skill) AS market_rank, "
        "CASE WHEN status = 'missing' THEN row_number() OVER (PARTITION BY status ORDER BY n DESC, skill) END AS missing_rank, "
        "round_even(CAST(5 AS DOUBLE) / (SELECT count(*) FROM gap) * 100, 1) AS skill_coverage, "
        "round_even(CAST((SELECT count(*) FROM gap WHERE status = 'covered') AS DOUBLE) / (SELECT count(*) FROM gap) * 100, 1) AS matched_coverage FROM gap",
    ),
)
def _(spark, sf):
    return an.skill_gap(skills.skill_frequency(names(spark, sf)), I.SKILLED)


@register(
    "learning_recs",
    O.query(
        *_NAMES, _FREQ, _GAP,
        "m AS (SELECT skill, row_number() OVER (ORDER BY n DESC, skill) AS missing_rank FROM gap WHERE status = 'missing')",
        "paths(k, advice) AS (VALUES " + ", ".join(f"({O.lit(k)}, {O.lit(v)})" for k, v in O.fv.LEARNING_PATHS.items()) + ")",
        "SELECT missing_rank, skill, skill || ': ' || advice AS recommendation FROM m JOIN paths ON k = skill WHERE missing_rank <= 5",
    ),
)
def _(spark, sf):
    return an.learning_recs(an.skill_gap(skills.skill_frequency(names(spark, sf)), Profile(("sql", "communication"))))


# The SQL above marks five skills as covered; this query's profile is shorter.
from workloads.registry import ORACLE as _ORACLE  # noqa: E402

_ORACLE["learning_recs"] = _ORACLE["learning_recs"].replace(
    "('sql', 'excel', 'python', 'tableau', 'dbt')", "('sql', 'communication')"
)

_GOOD = [
    O.RAW, O.JUNIOR, *O.greedy("junior"), f"located AS (SELECT * FROM uniq WHERE {O.REACH})", O.parsed("located"),
    *O.validated("parsed"), "good AS (SELECT * FROM checked WHERE len(reasons) = 0)", *O.skills("good"),
]


def _section(name: str, column: str, k: int | None) -> str:
    limit = f"QUALIFY rank <= {k}" if k else ""
    return (
        f"SELECT '{name}' AS section, row_number() OVER (ORDER BY count(*) DESC, {column}) AS rank, {column} AS key, CAST(count(*) AS DOUBLE) AS value "
        f"FROM good WHERE {column} IS NOT NULL GROUP BY {column} {limit}"
    )


def _summary_rows() -> str:
    items = (
        ("total_jobs", "count(*)"), ("unique_companies", "count(DISTINCT company)"), ("unique_locations", "count(DISTINCT country)"),
        ("remote_percentage", "round_even(CAST(count(*) FILTER (remote_type = 'remote') AS DOUBLE) / count(*) * 100, 1)"),
        ("visa_sponsorship_count", "count(*) FILTER (visa_sponsorship)"),
    )
    return " UNION ALL ".join(
        f"SELECT 'summary' AS section, {i} AS rank, '{k}' AS key, CAST({e} AS DOUBLE) AS value FROM good" for i, (k, e) in enumerate(items, 1)
    )


def _salary_rows() -> str:
    items = (("mean", "round_even(avg({c}), 0)"), ("median", "round_even(median({c}), 0)"), ("min", "min({c})"), ("max", "max({c})"))
    return " UNION ALL ".join(
        f"SELECT 'salary_analysis' AS section, {i} AS rank, '{bound} {k}' AS key, CAST({e.format(c=c)} AS DOUBLE) AS value FROM good WHERE {c} IS NOT NULL HAVING count(*) > 0"
        for bound, c in (("min_salary", "salary_min"), ("max_salary", "salary_max")) for i, (k, e) in enumerate(items, 1)
    )


_LONG = " UNION ALL ".join(f"({part})" for part in [
    *[_section(n, c, k) for n, c, k in (
        ("country_distribution", "country", 15), ("remote_trends", "remote_type", None), ("company_hiring", "company", 20),
        ("title_distribution", "normalized_title", 15), ("experience_distribution", "experience_level", None), ("source_distribution", "source", None),
    )],
    _summary_rows(), _salary_rows(),
    "SELECT 'top_skills' AS section, row_number() OVER (ORDER BY count(*) DESC, skill) AS rank, skill AS key, CAST(count(*) AS DOUBLE) AS value FROM hits GROUP BY skill QUALIFY rank <= 20",
    "SELECT 'skill_by_country' AS section, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, skill) AS rank, country || ' / ' || skill AS key, "
    "CAST(count(*) AS DOUBLE) AS value FROM hits GROUP BY country, skill QUALIFY rank <= 20",
])


def market(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Discovered, valid postings with their skill names, written once; and the exploded names."""
    from hirescope.session import materialize

    raw = I.texts(spark, sf)
    found = normalize.parse_postings(discover(raw, CFG), CFG)
    good = validate.accepted(validate.validate_postings(found, CFG))
    good = materialize(skills.extract_skill_names(good, CFG), "market")
    return good, skills.explode_names(good, "country")


@register("analytics_long", O.query(*_GOOD, f"long AS ({_LONG})", "SELECT section, CAST(rank AS INT) AS rank, key, value FROM long"))
def _(spark, sf):
    return an.analytics_long(*market(spark, sf))


@register("analytics_incremental", O.query(*_GOOD, f"long AS ({_LONG})", "SELECT section, CAST(rank AS INT) AS rank, key, value FROM long"))
def _(spark, sf):
    """The same report from ten runs counted in one after the other, one of them twice and one that is withdrawn."""
    good, _ = market(spark, sf)
    good, root = good.withColumn("run", F.expr("CAST(floor(ingest_seq / 5) AS BIGINT) % 10")), scratch_path(spark, "report")

    def add(run: str, rows: DataFrame) -> None:
        incremental.add_run(root, run, rows, skills.explode_names(rows, "country"))

    add("mistaken", good)
    add("0", good.where("run IN (0, 7)"))
    for i in range(10):
        add(str(i), good.where(F.col("run") == i))
    incremental.withdraw_run(spark, root, "mistaken")
    return incremental.report(spark, root)


_REPORT = (
    "report AS (SELECT section, rank, key || ': ' || CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS text FROM long "
    "WHERE (section = 'summary' AND rank <= 5) OR (section = 'top_skills' AND rank <= 20) OR (section = 'country_distribution' AND rank <= 15) "
    "OR (section IN ('company_hiring', 'title_distribution') AND rank <= 10) UNION ALL SELECT * FROM (SELECT 'sample_postings', row_number() OVER (ORDER BY posting_date DESC NULLS LAST, fingerprint, ingest_seq) AS rank, "
    "title || ' | ' || company || ' | ' || country || ' | ' || remote_type || ' | ' || source FROM good) WHERE rank <= 10)"
)


@register("report_rows", O.query(*_GOOD, f"long AS ({_LONG})", _REPORT, "SELECT section, CAST(rank AS INT) AS rank, text FROM report"))
def _(spark, sf):
    good, exploded = market(spark, sf)
    return export.report_rows(an.analytics_long(good, exploded), good)


@register(
    "latest_runs",
    "SELECT 'run-' || strftime(o_orderdate, '%Y-%m-%d') AS run_id, 'completed' AS status, count(*) AS jobs_found, "
    "count(*) FILTER (o_orderstatus <> 'P') AS jobs_validated, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS started_at "
    "FROM orders GROUP BY 1 ORDER BY started_at DESC, run_id LIMIT 10",
)
def _(spark, sf):
    return an.latest_runs(runs(spark, sf)).withColumn("started_at", seconds("started_at"))


def runs(spark, sf) -> DataFrame:
    """A run log from orders: one run per order day."""
    tagged = I.table(spark, sf, "orders").select(
        F.concat(F.lit("run-"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("run"),
        F.col("o_orderdate").cast("timestamp").alias("posting_date"),
        (F.col("o_orderstatus") != "P").alias("is_valid"),
    )
    # Through the log's own writer: two appends, read back with its schema.
    path = scratch_path(spark, "runs")
    log = conform(store.run_log_from(tagged, "run"), RUN_LOG)
    early = F.col("run_id") < "run-1995"
    store.append_run(log.where(early), path)
    store.append_run(log.where(~early), path)
    return spark.read.schema(RUN_LOG).parquet(path)


@register(
    "run_log",
    "SELECT 'run-' || strftime(o_orderdate, '%Y-%m-%d') AS run_id, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS started_at, "
    "strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS completed_at, 'completed' AS status, count(*) AS jobs_found, "
    "count(*) FILTER (o_orderstatus <> 'P') AS jobs_validated, count(*) FILTER (o_orderstatus = 'P') AS jobs_rejected FROM orders GROUP BY 1",
)
def _(spark, sf):
    log = runs(spark, sf).drop("metadata")
    return log.withColumns({"started_at": seconds("started_at"), "completed_at": seconds("completed_at")})


@register(
    "listing_page",
    O.query(
        O.RAW, PARSED, f"SELECT title, company, {O.ROLE} AS role_category, country, remote_type, experience_level, source, visa_sponsorship "
        "FROM parsed ORDER BY posting_date DESC NULLS LAST, fingerprint, ingest_seq LIMIT 100",
    ),
)
def _(spark, sf):
    from hirescope.operators.filters import classify_role

    slim = normalize.parse_postings(I.postings(spark, sf), CFG)
    return an.listing_page(classify_role(slim, CFG))


# --- recommendations ------------------------------------------------------------------------

def _match(profile_skills: str, years: int) -> str:
    return (
        "m AS (SELECT p.ingest_seq, p.title, p.experience_level, p.visa_sponsorship AS visa, count(h.skill) AS n, "
        f"count(h.skill) FILTER (h.skill IN ({profile_skills})) AS o, "
        f"coalesce(string_agg(h.skill, '|' ORDER BY h.skill) FILTER (h.skill NOT IN ({profile_skills})), '') AS missing_skills, "
        f"coalesce(string_agg(h.skill, '|' ORDER BY h.skill) FILTER (h.skill IN ({profile_skills})), '') AS strengths, "
        f"list(h.skill ORDER BY h.skill) FILTER (h.skill NOT IN ({profile_skills})) AS miss "
        "FROM parsed p LEFT JOIN hits h ON h.ingest_seq = p.ingest_seq GROUP BY ALL), "
        "b AS (SELECT *, CASE WHEN n = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(o AS DOUBLE) / n END AS base_score FROM m), "
        "e AS (SELECT *, CASE WHEN (contains(lower(experience_level), 'entry') OR contains(lower(experience_level), 'junior') OR contains(lower(experience_level), 'graduate')) "
        f"AND {years} <= 3 THEN least(base_score + CAST(0.1 AS DOUBLE), 1.0) ELSE base_score END AS s1 FROM b), "
        "s AS (SELECT *, CASE WHEN visa THEN least(s1 + CAST(0.05 AS DOUBLE), 1.0) ELSE s1 END AS raw_score FROM e), "
        "scored AS (SELECT *, round_even(raw_score * 100, 1) AS match_score, round_even(least(raw_score * 100 + 20, 100.0), 1) AS interview_readiness, "
        "round_even(least((raw_score * CAST(0.7 AS DOUBLE) + CASE WHEN visa THEN CAST(0.3 AS DOUBLE) ELSE 0.0 END) * 100, 100.0), 1) AS application_success_prob FROM s)"
    )


_MATCH = _match(O.PROFILE_SKILLS, 1)


def skilled(spark, sf) -> DataFrame:
    return skills.extract_skill_names(parsed(spark, sf), CFG)


@register("match_overlap", O.query(*_NAMES, _MATCH, "SELECT ingest_seq, o AS n_shared, n - o AS n_missing FROM scored"))
def _(spark, sf):
    found = rec.overlap_columns(skilled(spark, sf), I.PROFILE)
    return found.select(
        "ingest_seq", F.size("strengths").cast("bigint").alias("n_shared"), F.size("missing_skills").cast("bigint").alias("n_missing")
    )


@register("skill_set_diff", O.query(*_NAMES, _MATCH, "SELECT ingest_seq, strengths, missing_skills FROM scored"))
def _(spark, sf):
    found = rec.overlap_columns(skilled(spark, sf), I.PROFILE)
    return found.select("ingest_seq", joined("strengths"), joined("missing_skills"))


@register("match_base", O.query(*_NAMES, _MATCH, "SELECT ingest_seq, base_score FROM scored"))
def _(spark, sf):
    return rec.match_base(skilled(spark, sf), I.PROFILE).select("ingest_seq", "base_score")


@register("match_boost", O.query(*_NAMES, _MATCH, "SELECT ingest_seq, raw_score FROM scored"))
def _(spark, sf):
    return rec.match_boost(skilled(spark, sf), I.PROFILE).select("ingest_seq", "raw_score")


_OUTCOME = ("match_score", "interview_readiness", "application_success_prob")


@register("match_outcome", O.query(*_NAMES, _MATCH, f"SELECT ingest_seq, {', '.join(_OUTCOME)} FROM scored"))
def _(spark, sf):
    return rec.match_outcome(skilled(spark, sf), I.PROFILE).select("ingest_seq", *_OUTCOME)


_HINTS = "hints(k, hint) AS (VALUES " + ", ".join(f"({O.lit(k)}, {O.lit(v)})" for k, v in O.fv.LEARNING_HINTS.items()) + ")"
_ADVICE_SQL = (
    f"(CASE WHEN len(miss) > 0 THEN {O.lit(O.fv.ADVICE_ADD_SKILLS)} || array_to_string(miss[1:5], ', ') || '|' ELSE '' END || "
    f"CASE WHEN NOT visa THEN {O.lit(O.fv.ADVICE_NO_VISA)} || '|' ELSE '' END || {O.lit(O.fv.ADVICE_ALWAYS)}) AS resume_improvements, "
    "coalesce((SELECT string_agg(k || ': ' || hint, '|' ORDER BY k) FROM hints WHERE list_contains(miss[1:5], k)), '') AS learning_recs"
)


@register("match_advice", O.query(*_NAMES, _MATCH, _HINTS, f"SELECT ingest_seq, {_ADVICE_SQL} FROM scored"))
def _(spark, sf):
    advised = rec.match_advice(rec.overlap_columns(skilled(spark, sf), I.PROFILE))
    return advised.select("ingest_seq", joined("resume_improvements"), joined("learning_recs"))


@register(
    "match_jobs",
    O.query(*_NAMES, _MATCH, _HINTS, f"SELECT ingest_seq, title, {', '.join(_OUTCOME)}, missing_skills, strengths, {_ADVICE_SQL} FROM scored"),
)
def _(spark, sf):
    found = rec.match_jobs(skilled(spark, sf), I.PROFILE)
    lists = [joined(c) for c in ("missing_skills", "strengths", "resume_improvements", "learning_recs")]
    return found.select("ingest_seq", "title", *_OUTCOME, *lists)


@register(
    "rank_matches",
    O.query(
        *_NAMES, _MATCH, "SELECT ingest_seq, title, match_score, row_number() OVER (ORDER BY match_score DESC, ingest_seq) AS rank "
        "FROM scored QUALIFY rank <= 10",
    ),
)
def _(spark, sf):
    return rec.rank_matches(rec.match_jobs(skilled(spark, sf), I.PROFILE)).select("ingest_seq", "title", "match_score", "rank")


_CATEGORIES = (
    f"cats AS (SELECT role AS role_category, count(*) AS n FROM (SELECT {O.ROLE} AS role FROM parsed) WHERE role IS NOT NULL GROUP BY role), "
    "ranked AS (SELECT role_category, row_number() OVER (ORDER BY n DESC, role_category) AS category_rank FROM cats)"
)


@register("rec_categories", O.query(O.RAW, PARSED, _CATEGORIES, "SELECT role_category, category_rank FROM ranked"))
def _(spark, sf):
    from hirescope.operators.filters import classify_role

    return rec.rec_categories(classify_role(parsed(spark, sf), CFG), I.PROFILE)


def _catalog_sql() -> str:
    rows, seen = [], {}
    for row in CATALOG:
        seen[row[0]] = seen.get(row[0], 0) + 1
        terms = "[" + ", ".join(O.lit(s) for s in row[3]) + "]"
        rows.append(f"({O.lit(row[0])}, {seen[row[0]]}, {O.lit(row[1])}, {O.lit(row[2])}, {O.lit(row[4])}, {row[5]}, {terms})")
    return "catalog(role_category, catalog_order, title, industry, difficulty, estimated_hours, skills) AS (VALUES " + ", ".join(rows) + ")"


_DEMAND = (
    "demand AS (SELECT skill, count(*) AS n FROM hits GROUP BY skill), "
    "pd AS (SELECT role_category, catalog_order, sum(coalesce(n, 0))::BIGINT AS market_demand_score FROM "
    "(SELECT role_category, catalog_order, unnest(skills) AS skill FROM catalog) LEFT JOIN demand USING (skill) GROUP BY ALL)"
)
_ANNOTATED = (
    "ann AS (SELECT c.*, market_demand_score, "
    f"array_to_string(list_sort(list_filter(skills, lambda s: s IN ({O.PROFILE_SKILLS}))), '|') AS skills_you_have, "
    f"array_to_string(list_sort(list_filter(skills, lambda s: s NOT IN ({O.PROFILE_SKILLS}))), '|') AS skills_youll_build "
    "FROM catalog c JOIN pd USING (role_category, catalog_order))"
)


def demand(spark, sf) -> DataFrame:
    return skills.skill_demand(names(spark, sf))


@register("project_demand", O.query(*_NAMES, _catalog_sql(), _DEMAND, "SELECT role_category, catalog_order, market_demand_score FROM pd"))
def _(spark, sf):
    scored = rec.project_demand(project_catalog(spark), demand(spark, sf))
    return scored.select("role_category", "catalog_order", "market_demand_score")


@register(
    "project_annotate",
    O.query(*_NAMES, _catalog_sql(), _DEMAND, _ANNOTATED, "SELECT title, market_demand_score, skills_you_have, skills_youll_build FROM ann"),
)
def _(spark, sf):
    done = rec.project_annotate(project_catalog(spark), demand(spark, sf), I.PROFILE)
    return done.select("title", "market_demand_score", joined("skills_you_have"), joined("skills_youll_build"))


@register(
    "recommend_projects",
    O.query(
        *_NAMES, _catalog_sql(), _DEMAND, _ANNOTATED, _CATEGORIES,
        "SELECT title, role_category, industry, difficulty, estimated_hours, market_demand_score, skills_youll_build, "
        "row_number() OVER (ORDER BY market_demand_score DESC, category_rank, catalog_order) AS rank FROM ann JOIN ranked USING (role_category)",
    ),
)
def _(spark, sf):
    from hirescope.operators.filters import classify_role

    posts = classify_role(parsed(spark, sf), CFG)
    done = rec.recommend_projects(project_catalog(spark), posts, demand(spark, sf), I.PROFILE)
    return done.select(
        "title", "role_category", "industry", "difficulty", "estimated_hours", "market_demand_score",
        joined("skills_youll_build"), "rank",
    )


_USERS = "usr AS (SELECT " + ", ".join(f"{I.duck_rule(r)} AS {c}" for c, r in I.USER_RULES.items()) + " FROM customer)"


@register(
    "recommend_users",
    O.query(
        *_NAMES, _USERS,
        "us AS (SELECT DISTINCT user_id, unnest(string_split(lower(skills_text), '|')) AS skill FROM usr)",
        "pn AS (SELECT ingest_seq, count(*) AS n FROM hits GROUP BY ingest_seq)",
        "ov AS (SELECT user_id, ingest_seq, count(*) AS o FROM us JOIN hits USING (skill) GROUP BY ALL)",
        "pair AS (SELECT u.user_id, p.ingest_seq, u.experience_years AS y, p.visa_sponsorship AS visa, lower(p.experience_level) AS lv, "
        "CASE WHEN pn.n IS NULL THEN CAST(0.5 AS DOUBLE) ELSE coalesce(CAST(ov.o AS DOUBLE), 0.0) / pn.n END AS base FROM usr u CROSS JOIN parsed p "
        "LEFT JOIN pn ON pn.ingest_seq = p.ingest_seq LEFT JOIN ov ON ov.user_id = u.user_id AND ov.ingest_seq = p.ingest_seq)",
        "b1 AS (SELECT *, CASE WHEN (contains(lv, 'entry') OR contains(lv, 'junior') OR contains(lv, 'graduate')) AND y <= 3 THEN least(base + CAST(0.1 AS DOUBLE), 1.0) ELSE base END AS s1 FROM pair)",
        "b2 AS (SELECT user_id, ingest_seq, round_even(CASE WHEN visa THEN least(s1 + CAST(0.05 AS DOUBLE), 1.0) ELSE s1 END * 100, 1) AS match_score FROM b1)",
        "SELECT user_id, ingest_seq, match_score, row_number() OVER (PARTITION BY user_id ORDER BY match_score DESC, ingest_seq) AS rank FROM b2 QUALIFY rank <= 10",
    ),
)
def _(spark, sf):
    return rec.recommend_users(I.users(spark, sf), skilled(spark, sf), 10)


# --- exports: written to the shared folder and read back ----------------------------------------

_EXPORT_COLUMNS = ("ingest_seq", "title", "company", "country", "description_md5", "salary_min", "visa_sponsorship")
_EXPORT_SQL = O.query(
    O.RAW, PARSED, "SELECT ingest_seq, title, company, country, md5(description) AS description_md5, salary_min, visa_sponsorship FROM parsed"
)


def _with_md5(df: DataFrame) -> DataFrame:
    return df.withColumn("description_md5", F.md5(F.coalesce("description", F.lit("")))).select(*_EXPORT_COLUMNS)


def _exported(spark, sf) -> DataFrame:
    return parsed(spark, sf).select("ingest_seq", "title", "company", "country", "description", "salary_min", "visa_sponsorship")


@register("export_csv", _EXPORT_SQL)
def _(spark, sf):
    df = _exported(spark, sf)
    path = export.export_csv(df, scratch_path(spark, "csv"))
    back = export.read_csv(spark, path, df.schema).withColumns({c: F.coalesce(c, F.lit("")) for c in ("company", "country", "title")})
    return _with_md5(back)


@register("export_json", _EXPORT_SQL)
def _(spark, sf):
    df = _exported(spark, sf)
    path = export.export_json(df, scratch_path(spark, "json"))
    return _with_md5(spark.read.schema(df.schema).json(path))


@register(
    "export_bundle",
    O.query(
        *_NAMES, _FREQ, "SELECT 'Jobs' AS sheet, count(*) AS n FROM parsed UNION ALL SELECT 'Top_Skills', least(count(*), 20) FROM freq "
        "UNION ALL SELECT 'Country_Distribution', least(count(DISTINCT country), 15) FROM parsed",
    ).replace("WITH RECURSIVE", "WITH"),
)
def _(spark, sf):
    posts = parsed(spark, sf).drop("raw_data", "description")
    sheets = {
        "Jobs": posts,
        "Top_Skills": an.top_skills(names(spark, sf)),
        "Country_Distribution": an.country_distribution(posts),
        "Recommendations": posts.where("ingest_seq < 0"),  # an empty sheet is left out
    }
    written = export.export_bundle(sheets, scratch_path(spark, "bundle"))
    return _row_counts(spark, written, "sheet")


def _row_counts(spark, paths: dict[str, str], label: str) -> DataFrame:
    result = None
    for name, path in paths.items():
        part = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias(label), "n")
        result = part if result is None else result.unionByName(part)
    return result


@register(
    "export_all",
    O.query(
        *_GOOD, "SELECT 'sheet_Jobs' AS output, count(*) AS n FROM good UNION ALL SELECT 'sheet_Analytics_Summary', 5 "
        "UNION ALL SELECT 'sheet_Top_Skills', least(count(DISTINCT skill), 20) FROM hits "
        "UNION ALL SELECT 'sheet_Country_Distribution', least(count(DISTINCT country), 15) FROM good "
        "UNION ALL SELECT 'sheet_Recommendations', least(count(*), 20) FROM good",
    ),
)
def _(spark, sf):
    good, exploded = market(spark, sf)
    matches = rec.rank_matches(rec.match_jobs(good, I.PROFILE), 20)
    paths = export.export_all(good, an.analytics_long(good, exploded), "r1", scratch_path(spark, "all"), matches)
    sheets = {k: v for k, v in paths.items() if k.startswith("sheet_")}
    return _row_counts(spark, sheets, "output")
