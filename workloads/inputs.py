"""Input rules: postings, stored tables, users and landed payloads derived from the driver tables.

The rules below are plain SQL that Spark and DuckDB read alike, so the same text
feeds the queries and the SQL they are checked against. They are projections of
one driver table: no join, no shuffle, whole texts, every row.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from hirescope.config import Config, Profile

AS_OF = datetime(2024, 1, 10, tzinfo=timezone.utc)
AS_OF_MICROS = 1704844800000000
CFG = Config(as_of=AS_OF)
PROFILE = Profile(("sql", "excel", "python"), 1)
SKILLED = Profile(("SQL", "Excel", "Python", "Tableau", "dbt"), 1)

_CIDX = (
    "CASE WHEN doc_id % 4 = 0 THEN doc_id % 7 "
    "WHEN doc_id % 11 = 0 THEN abs(doc_id - 16) ELSE doc_id END"
)
_MICROS = (
    "1704067200000000 + (doc_id * 7919 % 259200) * 1000000 "
    "- CASE doc_id % 5 WHEN 0 THEN 45 WHEN 1 THEN 20 ELSE 0 END * 86400000000"
)

# column -> rule over the documents table; {ts} is the engine's "timestamp from microseconds"
POSTING_RULES = {
    "source": "source",
    "external_id": "CASE WHEN doc_id % 17 = 0 THEN CAST(abs(doc_id - 20) AS {text}) ELSE CAST(doc_id AS {text}) END",
    # Every third title and company carries words of the text.
    "title": """CASE doc_id % 16
        WHEN 0 THEN 'Junior Data Analyst - Remote'
        WHEN 1 THEN 'Customer Success Associate (EMEA)'
        WHEN 2 THEN 'Senior Data Engineer'
        WHEN 3 THEN 'Business Development Representative'
        WHEN 4 THEN 'Warehouse Operative'
        WHEN 5 THEN 'Graduate Business Analyst'
        WHEN 6 THEN 'Head of Customer Service'
        WHEN 7 THEN 'Data Scientist – Hybrid'
        WHEN 8 THEN 'Technical Support Specialist'
        WHEN 9 THEN 'Graphic Designer'
        WHEN 10 THEN '  BI Developer (Tableau / Power BI)  '
        WHEN 11 THEN 'Jr. Marketing Analyst - Full-time, Berlin'
        WHEN 12 THEN 'Trainee SDR (Inbound)'
        WHEN 13 THEN 'SQL Server & Python Data Engineer Intern'
        WHEN 14 THEN 'Customer Support Agent (Zendesk) - Part time'
        ELSE 'Entry Level Financial Analyst' END ||
        CASE WHEN doc_id % 3 = 1 THEN ' ' || replace(right(coalesce(text, ''), 24), chr(10), ' ') ELSE '' END""",
    "company": f"""CASE WHEN doc_id % 97 = 0 THEN '' WHEN doc_id % 29 = 0 THEN 'Acme Staffing Agency'
        WHEN doc_id % 13 = 0 THEN 'Company ' || CAST({_CIDX} AS {{text}}) || ', Inc.'
        WHEN doc_id % 19 = 0 THEN ' COMPANY ' || CAST({_CIDX} AS {{text}}) || ' '
        ELSE 'Company ' || CAST({_CIDX} AS {{text}}) END ||
        CASE WHEN doc_id % 3 = 2 AND doc_id % 4 <> 0 AND doc_id % 11 <> 0 THEN ' ' || substr(coalesce(text, ''), 1, 12) ELSE '' END""",
    "company_id": f"CAST({_CIDX} AS BIGINT)",
    "url": """CASE WHEN doc_id % 31 = 0 THEN 'ftp://x/' || CAST(doc_id AS {text}) WHEN doc_id % 53 = 0 THEN 'http://x'
        WHEN doc_id % 59 = 0 THEN '' ELSE 'https://jobs.example.com/' || CAST(doc_id AS {text}) END""",
    "apply_url": "CASE doc_id % 4 WHEN 1 THEN 'https://apply.example.com/' || CAST(doc_id AS {text}) WHEN 2 THEN '' END",
    "description": """CASE WHEN doc_id % 101 = 0 THEN NULL ELSE
        CASE WHEN doc_id % 12 = 5 THEN '' ELSE 'Required: SQL and Python. ' ||
            CASE doc_id % 7 WHEN 0 THEN 'Tableau, Excel, R. '
            WHEN 1 THEN 'Salesforce; lead generation and CSAT. '
            WHEN 2 THEN 'make money fast, earn $ now, wire transfer. '
            WHEN 3 THEN 'Qualifications: SQL Server, REST API, CI/CD.' || chr(10) || 'We use GitHub Actions and C++17. '
            WHEN 4 THEN 'Nice to have: dbt, Airflow, Spark. '
            WHEN 5 THEN '<p>Must have <b>Power BI</b></p>' || chr(10) || 'B2B sales development, voice of customer success. '
            ELSE 'Communication, teamwork, python. ' END END || text END""",
    "country": """CASE doc_id % 8 WHEN 0 THEN 'Remote' WHEN 1 THEN 'United States' WHEN 2 THEN 'Berlin, Germany'
        WHEN 3 THEN 'uk' WHEN 4 THEN 'Japan' WHEN 6 THEN ' Ireland' WHEN 7 THEN 'EU' END""",
    "city": "CASE doc_id % 3 WHEN 0 THEN 'Berlin' WHEN 1 THEN '' END",
    "remote_type": "CASE doc_id % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' ELSE 'unknown' END",
    "salary_min": "CASE WHEN doc_id % 3 = 0 THEN CAST(30000 + n_chars * 7 % 40000 AS INT) END",
    "salary_max": "CASE WHEN doc_id % 6 = 0 THEN CAST(45000 + n_chars * 11 % 60000 AS INT) END",
    "salary_currency": "CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'USD' ELSE 'EUR' END END",
    "experience_level": "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Junior' WHEN 2 THEN 'Senior' WHEN 3 THEN 'Intermediate' ELSE 'Entry-Level' END",
    "employment_type": """CASE WHEN doc_id % 50 = 7 THEN NULL ELSE CASE doc_id % 9 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'internship'
        WHEN 2 THEN 'Contract' WHEN 3 THEN 'part time' WHEN 4 THEN 'Graduate scheme' ELSE 'unknown' END END""",
    "visa_sponsorship": "doc_id % 5 = 0",
    "international_hiring": "doc_id % 7 = 0",
    "relocation_support": "doc_id % 9 = 0",
    "posting_date": f"CASE WHEN doc_id % 5 <> 2 THEN {{ts}}({_MICROS}) END",
    "closing_date": "CAST(NULL AS TIMESTAMP)",
    "role_category": "CAST(NULL AS {text})",
    "raw_data": "CAST(NULL AS {text})",
    "ingest_seq": "doc_id",
}

# Users: one per customer, with two to five skills, some of them outside the taxonomy.
USER_RULES = {
    "user_id": "c_custkey",
    "skills_text": """CASE WHEN c_custkey % 23 = 0 THEN 'juggling' ELSE
        CASE c_custkey % 5 WHEN 0 THEN 'sql|python' WHEN 1 THEN 'SQL|excel' WHEN 2 THEN 'salesforce|csat|lead generation'
        WHEN 3 THEN 'python|dbt|airflow|spark' ELSE 'communication|sales development' END ||
        CASE c_custkey % 3 WHEN 0 THEN '|tableau' WHEN 1 THEN '|power bi|customer success' ELSE '' END END""",
    "experience_years": "CAST(c_custkey % 8 AS INT)",
}


def spark_rule(rule: str) -> str:
    return rule.format(ts="timestamp_micros", text="STRING")


def duck_rule(rule: str) -> str:
    return rule.format(ts="make_timestamp", text="VARCHAR")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_postings(documents: DataFrame) -> DataFrame:
    """Works on a batch and on a streaming frame."""
    return documents.selectExpr(*[f"{spark_rule(r)} AS {c}" for c, r in POSTING_RULES.items()])


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_postings(table(spark, sf_dir, "documents"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same postings, for queries that scan the texts."""
    return postings(spark, sf_dir)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr(*[f"{spark_rule(r)} AS {c}" for c, r in USER_RULES.items()])
    return rows.selectExpr("user_id", "split(skills_text, '[|]') AS skills", "experience_years")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS company_id", "c_name AS name", "c_mktsegment AS industry"
    )


# --- landed payloads -------------------------------------------------------------
# board -> (context rule, payload as nested dict of rules). A dict becomes a JSON
# object, a one-element list a JSON array. Rules see the posting columns above.

_SEQ = "CAST(ingest_seq AS {text})"
_ISO = (
    "CASE ingest_seq % 7 WHEN 0 THEN '2024-01-0' || CAST(1 + ingest_seq % 9 AS {text}) "
    "WHEN 1 THEN '2024-01-05T08:30:00Z' WHEN 2 THEN '2024-01-05T08:30:15+02:00' "
    "WHEN 3 THEN 'not a date' WHEN 4 THEN '2024-01-06T23:59:59.250' WHEN 5 THEN '2023-11-20T06:00:00Z' ELSE '' END"
)
_BOARD = "CASE ingest_seq % 3 WHEN 0 THEN 'stripe' WHEN 1 THEN 'booking-holding' ELSE 'data dog' END"
_CODE = "CASE ingest_seq % 4 WHEN 0 THEN 'gb' WHEN 1 THEN 'us' WHEN 2 THEN 'de' ELSE 'xx' END"
_PAY = (
    "CASE ingest_seq % 6 WHEN 0 THEN '$60,000 - $80,000' WHEN 1 THEN '€45k' WHEN 2 THEN 'competitive' "
    "WHEN 3 THEN '£30,500 to £42,000 plus 10% bonus' WHEN 4 THEN '' ELSE '55000 USD' END"
)
_PLACE = (
    "CASE ingest_seq % 9 WHEN 0 THEN 'Austria' WHEN 1 THEN 'Remote - US' WHEN 2 THEN 'London, UK' WHEN 3 THEN '' "
    "WHEN 4 THEN 'Dublin, Ireland' WHEN 5 THEN 'Worldwide' WHEN 6 THEN 'Tokyo, Japan' WHEN 7 THEN 'Sydney, Australia' "
    "ELSE 'Oslo, Norway' END"
)
_AGE = (
    "CASE ingest_seq % 7 WHEN 0 THEN 'Posted 3 days ago' WHEN 1 THEN '2 hours ago' WHEN 2 THEN 'today' "
    "WHEN 3 THEN '45 Minutes ago' WHEN 4 THEN '2 weeks ago' WHEN 5 THEN '30+ posted' ELSE '1 day ago' END"
)
# Now and then a record lacks its title.
_TITLE = "CASE WHEN ingest_seq % 41 = 0 THEN '' ELSE title END"

PAYLOADS: dict[str, tuple[str, dict]] = {
    "remoteok": ("''", {
        "id": _SEQ, "position": _TITLE, "company": "company", "date": _ISO,
        "remote": "ingest_seq % 4 <> 1", "location": _PLACE, "description": "description",
        "salary_min": "CASE ingest_seq % 5 WHEN 0 THEN '50000' WHEN 1 THEN '0' WHEN 2 THEN 'n/a' END",
        "salary_max": "CASE ingest_seq % 5 WHEN 0 THEN '70000' WHEN 1 THEN '60000' END",
        "url": "CASE WHEN ingest_seq % 2 = 0 THEN url ELSE '' END",
    }),
    "remotive": ("''", {
        "id": "ingest_seq", "title": _TITLE, "company_name": "company", "publication_date": _ISO,
        "candidate_required_location": _PLACE, "salary": _PAY, "url": "url", "description": "description",
    }),
    "greenhouse": (_BOARD, {
        "id": "ingest_seq", "title": _TITLE, "absolute_url": "CASE WHEN ingest_seq % 3 > 0 THEN url END",
        "updated_at": _ISO, "created_at": "'2024-01-02T00:00:00Z'", "location": {"name": _PLACE},
    }),
    "lever": (_BOARD, {
        "id": _SEQ, "text": _TITLE, "hostedUrl": "url", "applyUrl": "apply_url",
        "createdAt": "1704067200000 + ingest_seq * 1000",
        "categories": {"team": "'Ops'", "department": "'Ops'", "location": _PLACE},
    }),
    "ashby": (_BOARD, {
        "id": _SEQ, "title": _TITLE, "locationName": _PLACE, "employmentType": "employment_type",
        "departmentName": "'Data'", "teamName": "'BI'", "url": "url", "createdAt": _ISO,
    }),
    "smartrecruiters": (_BOARD, {"content": [{
        "id": _SEQ, "name": _TITLE, "ref": "CASE WHEN ingest_seq % 3 = 0 THEN '' ELSE 'ref-' || " + _SEQ + " END",
        "releasedDate": _ISO, "applyUrl": "apply_url", "location": {"city": "city", "country": _PLACE},
    }]}),
    "adzuna": (_CODE, {
        "id": "ingest_seq", "title": _TITLE, "redirect_url": "url", "description": "description",
        "created": _ISO, "salary_min": "salary_min", "salary_max": "CAST(salary_max AS DOUBLE) + 0.5",
        "company": {"display_name": "company"}, "location": {"display_name": _PLACE},
    }),
    "eu_startup_jobs": ("''", {
        "id": "ingest_seq", "title": _TITLE, "company": {"name": "company"},
        "apply_url": "apply_url", "url": "url", "description": "description", "location": _PLACE,
        "remote": "ingest_seq % 3 = 0", "created_at": _ISO, "published_at": "'2024-01-03T10:00:00Z'",
    }),
    "welcometothejungle": ("''", {
        "objectID": "CASE WHEN ingest_seq % 5 > 0 THEN " + _SEQ + " END", "name": _TITLE,
        "slug": "CASE WHEN ingest_seq % 4 > 0 THEN 'job-' || " + _SEQ + " ELSE '' END",
        "organization": {"name": "company", "slug": "'org-' || " + _SEQ},
        "offices": [{"country": "country", "country_code": "'XX'", "city": "city"}],
        "published_at": _ISO, "experience_level_minimum": "ingest_seq % 7",
        "remote": "CASE ingest_seq % 4 WHEN 0 THEN 'full_remote' WHEN 1 THEN 'fulltime' WHEN 2 THEN 'no' END",
        "summary": "description", "salary_minimum": "salary_min", "salary_maximum": "'k'",
        "salary_currency": "salary_currency", "contract_type": "employment_type",
    }),
    "workday": (_BOARD, {
        "title": _TITLE, "name": "'Fallback Sr Analyst'",
        "externalPath": "CASE WHEN ingest_seq % 4 > 0 THEN '/job/' || " + _SEQ + " ELSE '' END",
        "bulletFields": ["'R-' || " + _SEQ], "locationsText": _PLACE, "location": "country",
        "postedOn": _ISO, "startDate": "'2024-01-04'",
    }),
}


def spark_json(shape) -> str:
    def build(node) -> str:
        if isinstance(node, dict):
            return "named_struct(" + ", ".join(f"'{k}', {build(v)}" for k, v in node.items()) + ")"
        if isinstance(node, list):
            return f"array({build(node[0])})"
        return spark_rule(node)

    return f"to_json({build(shape)})"


def duck_json(shape) -> str:
    if isinstance(shape, dict):
        return "json_object(" + ", ".join(f"'{k}', {duck_json(v)}" for k, v in shape.items()) + ")"
    if isinstance(shape, list):
        return f"json_array({duck_json(shape[0])})"
    return duck_rule(shape)


# HTML boards: every row of `pages` is one result page. Cards are made from the
# page's own address; the page's html (with list items that are no cards) follows.
CARD_PAGES = {
    "linkedin": ("'United Kingdom'", """
        '<ul><li class="c"><div><a class="base-card__full-link x" href="' || url || '-' || CAST(page_id AS {text}) || '?trk=1"> link </a>
        <h3 class="base-search-card__title"> Junior Data Analyst &amp; BI </h3>
        <h4 class="base-search-card__subtitle"><a href="/c"> Company ' || CAST(page_id % 50 AS {text}) || ' </a></h4>
        <span class="job-search-card__location">Leeds, UK</span><time class="d" datetime="2024-01-0' || CAST(1 + page_id % 9 AS {text}) || '">x</time></div></li>
        <li><a href="https://www.example.com/jobs/view/lead-role-9' || CAST(page_id AS {text}) || '/" class="base-card__full-link">l</a>
        <h3 class="base-search-card__title">Lead Analyst</h3><h4 class="base-search-card__subtitle">Acme</h4></li>
        <li><h3 class="base-search-card__title">No Company</h3></li></ul>' || html"""),
    "indeed": ("'us|United States'", """
        '<div class="jobsearch-ResultsList"><div class="cardOutline job_seen_beacon"><h2 class="jobTitle css"><a id="job_a' || CAST(page_id AS {text}) || '" data-jk="jk' || CAST(page_id AS {text}) || '" href="/rc/clk?jk=' || CAST(page_id AS {text}) || '&amp;x=1"><span>Data Analyst</span></a></h2>
        <div><span data-testid="company-name">Company ' || CAST(page_id % 50 AS {text}) || '</span><div data-testid="text-location">Austin, TX 78701</div></div><span class="date">Posted ' || CAST(1 + page_id % 20 AS {text}) || ' days ago</span></div>
        <div class="job_seen_beacon"><a class="jcs-JobTitle z" id="job_b' || CAST(page_id AS {text}) || '" href="https://other.example.com/j">Sr Engineer</a><span class="date">today</span></div>
        <div class="job_seen_beacon"><span class="companyName">No Title</span></div></div>' || html"""),
}

# Boards in the order that decides which payload a posting lands as.
LANDING_BOARDS = tuple(PAYLOADS)


def landing_of(spark: SparkSession, sf_dir: str, board: str) -> DataFrame:
    """Every document landed as a payload of one JSON board, or every page as one of an HTML board."""
    if board in CARD_PAGES:
        context, page = CARD_PAGES[board]
        return table(spark, sf_dir, "pages").selectExpr(
            f"'{board}' AS source", f"{spark_rule(context)} AS context",
            f"{spark_rule(page)} AS payload", "page_id AS ingest_seq",
        )
    context, shape = PAYLOADS[board]
    return texts(spark, sf_dir).selectExpr(
        f"'{board}' AS source", f"{spark_rule(context)} AS context",
        f"{spark_json(shape)} AS payload", "ingest_seq",
    )


def as_landing(raw: DataFrame) -> DataFrame:
    """Postings landed as payloads of all JSON boards in turn; now and then a payload is unreadable."""
    def by_board(rules: list[str]) -> str:
        cases = " ".join(f"WHEN {i} THEN {r}" for i, r in enumerate(rules))
        return f"CASE ingest_seq % {len(LANDING_BOARDS)} {cases} END"

    names = by_board([f"'{b}'" for b in LANDING_BOARDS])
    contexts = by_board([spark_rule(PAYLOADS[b][0]) for b in LANDING_BOARDS])
    payloads = by_board([spark_json(PAYLOADS[b][1]) for b in LANDING_BOARDS])
    return raw.selectExpr(
        f"{names} AS source", f"{contexts} AS context",
        f"CASE WHEN ingest_seq % 37 = 0 THEN '<broken' ELSE {payloads} END AS payload", "ingest_seq",
        "coalesce(posting_date, timestamp_micros(1704067200000000)) AS landed_at",
    )


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_landing(texts(spark, sf_dir))
