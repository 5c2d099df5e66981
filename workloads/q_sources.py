"""Queries: board mappings, their union, per-source dedup."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirescope import sources
from hirescope.fixed_values import SOURCE_CAPS
from hirescope.schemas import POSTING_FIELDS
from workloads import inputs as I
from workloads import oracle as O
from workloads.q_postings import GRADED_SQL, SALARY_SQL, country_sql, iso_sql, level_sql, relative_sql
from workloads.registry import register, seconds

CFG = I.CFG
LEVELS = O.fv.LEVEL_WORDS
_COLUMNS = [f.name for f in POSTING_FIELDS.fields if f.name not in ("raw_data", "closing_date", "role_category")]
_BASE = {
    "apply_url": "NULL", "description": "NULL", "city": "NULL", "remote_type": "'unknown'", "salary_min": "CAST(NULL AS INT)",
    "salary_max": "CAST(NULL AS INT)", "salary_currency": "NULL", "employment_type": "'unknown'", "visa_sponsorship": "FALSE",
    "international_hiring": "FALSE", "relocation_support": "FALSE", "posting_date": "CAST(NULL AS TIMESTAMP)",
}


def s(path: str) -> str:
    """Text of a JSON field, empty if it is missing."""
    return f"coalesce(j->>'$.{path}', '')"


def titled(c: str) -> str:
    """Upper-case letter after each non-letter, for the ASCII names of the boards."""
    return (
        f"(SELECT string_agg(CASE WHEN i = 1 OR NOT regexp_matches(substr(b, i - 1, 1), '[a-z]') THEN upper(substr(b, i, 1)) "
        f"ELSE substr(b, i, 1) END, '' ORDER BY i) FROM (SELECT {c} AS b, unnest(range(1, length({c}) + 1)) AS i))"
    )


def nz(c: str) -> str:
    return f"nullif(TRY_CAST(trunc(TRY_CAST({c} AS DOUBLE)) AS INT), 0)"


def mapping(source: str, keep: str, title: str, **columns: str) -> str:
    """SELECT list of one board over CTE ``l`` (doc_id, ctx, j)."""
    exprs = {**_BASE, "source": f"'{source}'", "title": title, **columns}
    exprs["posting_date"] = O.ts(f"CAST({exprs['posting_date']} AS TIMESTAMP)")
    # Level rules read a column called title.
    level = exprs.pop("experience_level").replace("lower(title)", f"lower({title})")
    picked = ", ".join(f"{e} AS {c}" for c, e in {**exprs, "experience_level": level}.items())
    return f"SELECT {picked}, CAST(seq AS HUGEINT) * 2147483648 AS ingest_seq FROM l WHERE {keep}"


def place(t: str) -> str:
    return f"(SELECT {country_sql('t')} FROM (SELECT {t} AS t))"


JSON_MAPPINGS = {
    "remoteok": mapping(
        "remoteok", f"{s('position')} <> '' AND {s('company')} <> '' AND {s('salary_min')} <> 'n/a'", s("position"),
        external_id=s("id"), company=s("company"), url=f"'https://remoteok.com/remote-jobs/' || {s('id')}",
        apply_url=f"CASE WHEN {s('url')} = '' THEN 'https://remoteok.com/remote-jobs/' || {s('id')} ELSE {s('url')} END",
        description=s("description"), country=place(s("location")), city=s("location"),
        remote_type="CASE WHEN j->>'$.remote' = 'false' THEN 'onsite' ELSE 'remote' END",
        salary_min=nz("j->>'$.salary_min'"), salary_max=nz("j->>'$.salary_max'"),
        experience_level=GRADED_SQL, posting_date=iso_sql(s("date")),
    ),
    "remotive": mapping(
        "remotive", f"{s('title')} <> '' AND {s('company_name')} <> ''", s("title"),
        external_id=s("id"), company=s("company_name"), url=s("url"), apply_url=s("url"), description=s("description"),
        country=f"CASE WHEN {s('candidate_required_location')} = '' OR contains(lower({s('candidate_required_location')}), 'worldwide') "
        f"THEN 'Remote' ELSE trim({s('candidate_required_location')}) END",
        remote_type="'remote'", **{c: e.format(t=s("salary")) for c, e in SALARY_SQL.items()},
        experience_level=level_sql(LEVELS["remotive"]), posting_date=iso_sql(s("publication_date")),
    ),
    "greenhouse": mapping(
        "greenhouse", f"{s('title')} <> ''", s("title"), external_id=f"ctx || '_' || {s('id')}", company=titled("ctx"),
        url=f"coalesce(j->>'$.absolute_url', 'https://boards.greenhouse.io/' || ctx || '/jobs/' || {s('id')})",
        apply_url=f"coalesce(j->>'$.absolute_url', 'https://boards.greenhouse.io/' || ctx || '/jobs/' || {s('id')})",
        country=s("location.name"), experience_level=level_sql(LEVELS["greenhouse"]),
        posting_date=f"CASE WHEN {s('updated_at')} <> '' THEN {iso_sql(s('updated_at'))} ELSE TIMESTAMP '2024-01-02 00:00:00' END",
    ),
    "lever": mapping(
        "lever", f"{s('text')} <> ''", s("text"), external_id=s("id"), company=titled("ctx"), url=s("hostedUrl"),
        apply_url=f"CASE WHEN {s('applyUrl')} = '' THEN {s('hostedUrl')} ELSE {s('applyUrl')} END",
        country=s("categories.location"), experience_level=level_sql(LEVELS["lever"]),
        posting_date="make_timestamp(CAST(j->>'$.createdAt' AS BIGINT) * 1000)",
    ),
    "ashby": mapping(
        "ashby", f"{s('title')} <> ''", s("title"), external_id=s("id"), company=titled("ctx"),
        url=f"CASE WHEN {s('url')} = '' THEN 'https://jobs.ashbyhq.com/' || ctx || '/' || {s('id')} ELSE {s('url')} END",
        apply_url=f"CASE WHEN {s('url')} = '' THEN 'https://jobs.ashbyhq.com/' || ctx || '/' || {s('id')} ELSE {s('url')} END",
        country=s("locationName"), employment_type=f"coalesce(nullif(lower({s('employmentType')}), ''), 'unknown')",
        experience_level=level_sql(LEVELS["ashby"]), posting_date=iso_sql(s("createdAt")),
    ),
    "smartrecruiters": mapping(
        "smartrecruiters", f"{s('content[0].name')} <> ''", s("content[0].name"),
        external_id=f"CASE WHEN {s('content[0].ref')} = '' THEN {s('content[0].id')} ELSE {s('content[0].ref')} END", company=titled("ctx"),
        url=f"'https://careers.smartrecruiters.com/' || ctx || '/' || {s('content[0].ref')}",
        apply_url=f"coalesce(j->>'$.content[0].applyUrl', 'https://careers.smartrecruiters.com/' || ctx || '/' || {s('content[0].ref')})",
        country=s("content[0].location.country"), city=s("content[0].location.city"),
        experience_level=level_sql(LEVELS["smartrecruiters"]), posting_date=iso_sql(s("content[0].releasedDate")),
    ),
    "adzuna": mapping(
        "adzuna", f"{s('title')} <> ''", s("title"), external_id=s("id"), company=s("company.display_name"),
        url=s("redirect_url"), apply_url=s("redirect_url"), description=s("description"),
        country=O.case_of("ctx", O.fv.COUNTRY_CODES, "ctx"), city=f"split_part({s('location.display_name')}, ',', 1)",
        salary_min=nz("j->>'$.salary_min'"), salary_max=nz("j->>'$.salary_max'"),
        salary_currency="CASE WHEN ctx = 'gb' THEN 'GBP' ELSE 'EUR' END",
        experience_level=level_sql(LEVELS["adzuna"]), posting_date=iso_sql(s("created")),
    ),
    "eu_startup_jobs": mapping(
        "eu_startup_jobs", f"{s('title')} <> ''", s("title"), external_id=s("id"), company=s("company.name"),
        url=f"CASE WHEN {s('apply_url')} = '' THEN {s('url')} ELSE {s('apply_url')} END",
        apply_url=f"CASE WHEN {s('apply_url')} = '' THEN {s('url')} ELSE {s('apply_url')} END", description=s("description"),
        country=f"CASE WHEN j->>'$.remote' = 'true' THEN 'Remote' ELSE {s('location')} END", city=f"split_part({s('location')}, ',', 1)",
        remote_type="CASE WHEN j->>'$.remote' = 'true' THEN 'remote' ELSE 'hybrid' END",
        experience_level=level_sql(LEVELS["eu_startup_jobs"]),
        posting_date=f"CASE WHEN {s('created_at')} <> '' THEN {iso_sql(s('created_at'))} ELSE TIMESTAMP '2024-01-03 10:00:00' END",
    ),
    "welcometothejungle": mapping(
        "welcometothejungle", f"{s('name')} <> ''", s("name"),
        external_id=f"CASE WHEN {s('objectID')} <> '' THEN {s('objectID')} WHEN {s('slug')} <> '' THEN {s('slug')} ELSE 'https://www.welcometothejungle.com/en/jobs' END",
        company=s("organization.name"),
        url=f"CASE WHEN {s('slug')} <> '' THEN 'https://www.welcometothejungle.com/en/companies/' || {s('organization.slug')} || '/jobs/' || {s('slug')} ELSE 'https://www.welcometothejungle.com/en/jobs' END",
        apply_url=f"CASE WHEN {s('slug')} <> '' THEN 'https://www.welcometothejungle.com/en/companies/' || {s('organization.slug')} || '/jobs/' || {s('slug')} ELSE 'https://www.welcometothejungle.com/en/jobs' END",
        description=s("summary"), country=f"CASE WHEN {s('offices[0].country')} = '' THEN {s('offices[0].country_code')} ELSE {s('offices[0].country')} END",
        city=s("offices[0].city"), remote_type=f"CASE WHEN {s('remote')} IN ('full_remote', 'partial', 'no', 'punctual') THEN {s('remote')} ELSE 'unknown' END",
        salary_min="TRY_CAST(j->>'$.salary_minimum' AS INT)", salary_currency="j->>'$.salary_currency'",
        employment_type=f"coalesce(nullif({s('contract_type')}, ''), 'unknown')",
        experience_level="CASE WHEN CAST(j->>'$.experience_level_minimum' AS DOUBLE) >= 4 THEN 'Senior' ELSE 'Entry-Level' END",
        posting_date=iso_sql(s("published_at")),
    ),
    "workday": mapping(
        "workday", "TRUE", f"CASE WHEN {s('title')} = '' THEN {s('name')} ELSE {s('title')} END",
        external_id=f"CASE WHEN {s('externalPath')} = '' THEN {s('bulletFields[0]')} ELSE {s('externalPath')} END", company=titled("ctx"),
        url=f"'https://' || ctx || '.myworkdayjobs.com' || {s('externalPath')}",
        country=f"CASE WHEN {s('locationsText')} = '' THEN {s('location')} ELSE {s('locationsText')} END",
        experience_level=level_sql(LEVELS["workday"]),
        posting_date=f"CASE WHEN {s('postedOn')} <> '' THEN {iso_sql(s('postedOn'))} ELSE TIMESTAMP '2024-01-04 00:00:00' END",
    ),
}


def landed(board: str, source: str = "raw", name: str = "l") -> str:
    context, shape = I.PAYLOADS[board]
    return f"{name} AS (SELECT ingest_seq AS seq, {I.duck_rule(context)} AS ctx, {I.duck_json(shape)} AS j FROM {source})"


# Arrival numbers are wider than 64 bits.
_AS_TEXT = "SELECT * REPLACE (CAST(ingest_seq AS VARCHAR) AS ingest_seq) FROM"


def _arrival():
    return F.col("ingest_seq").cast("string").alias("ingest_seq")


def tidy(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in _COLUMNS if c != "posting_date"], seconds("posting_date"), _arrival())


def _register(board: str, key: str) -> None:
    @register(key, O.query(O.RAW, landed(board), f"{_AS_TEXT} ({JSON_MAPPINGS[board]})"))
    def _(spark, sf):
        return tidy(sources.map_source(I.landing_of(spark, sf, board), board, CFG))


for _board, _key in (
    ("remoteok", "src_remoteok"), ("remotive", "src_remotive"), ("greenhouse", "src_greenhouse"), ("lever", "src_lever"),
    ("ashby", "src_ashby"), ("smartrecruiters", "src_smartrecruiters"), ("adzuna", "src_adzuna"),
    ("eu_startup_jobs", "src_eu_startup"), ("welcometothejungle", "src_wttj"), ("workday", "src_workday"),
):
    _register(_board, _key)


# --- HTML cards: the SQL walks the page with the same cuts and simple patterns ------------

def _pick(html: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({html}, '{pattern}', {group}, 'is')"


def _text(html: str) -> str:
    return f"replace(trim(regexp_replace({html}, '<[^>]+>', '', 'g')), '&amp;', '&')"


_LI_TITLE = _text(_pick("c", '<h3[^>]*base-search-card__title[^>]*>(.*?)</h3>'))
_LI_COMPANY = _text(_pick("c", '<h4[^>]*base-search-card__subtitle[^>]*>(.*?)</h4>'))
_LI_URL = "split_part(" + _pick(_pick("c", '<a[^>]*base-card__full-link[^>]*>', 0), 'href="([^"]*)"') + ", '?', 1)"
_LI_CITY = _text(_pick("c", '<span[^>]*job-search-card__location[^>]*>(.*?)</span>'))
_CARD_TS = "CAST({} AS TIMESTAMP)"

_linkedin_level = level_sql(LEVELS["linkedin"])
_LINKEDIN = (
    "cards AS (SELECT page_id, unnest(range(len(a))) AS pos, unnest(a) AS c FROM (SELECT page_id, regexp_extract_all("
    + I.duck_rule(I.CARD_PAGES["linkedin"][1]) + ", '<li\\b[^>]*>(.*?)</li>', 1, 'is') AS a FROM pages))",
    f"parts AS (SELECT CAST(CAST(page_id AS HUGEINT) * 2147483648 + pos AS VARCHAR) AS ingest_seq, {_LI_TITLE} AS title, {_LI_COMPANY} AS company, {_LI_URL} AS url, {_LI_CITY} AS city, "
    f"try_strptime({_pick('c', '<time[^>]*datetime=' + chr(34) + '([^' + chr(34) + ']*)')}, '%Y-%m-%d') AS d FROM cards)",
    "SELECT ingest_seq, title, company, url, url AS apply_url, city, 'United Kingdom' AS country, "
    "regexp_extract(rtrim(url, '/'), '([^/-]*)$', 1) AS external_id, "
    f"{_linkedin_level} AS experience_level, {O.ts('d')} AS posting_date FROM parts WHERE title <> '' AND company <> '' AND url <> ''",
)
_CARD_COLUMNS = ("ingest_seq", "title", "company", "url", "apply_url", "city", "country", "external_id", "experience_level")


@register("src_linkedin_cards", O.query(*_LINKEDIN))
def _(spark, sf):
    found = sources.map_source(I.landing_of(spark, sf, "linkedin"), "linkedin", CFG)
    return found.select(_arrival(), *_CARD_COLUMNS[1:], seconds("posting_date"))


_INDEED = (
    "cards AS (SELECT page_id, unnest(range(len(a))) AS pos, unnest(a) AS c FROM (SELECT page_id, (string_split(replace(replace("
    + I.duck_rule(I.CARD_PAGES["indeed"][1])
    + ", '<div class=\"cardOutline job_seen_beacon\">', chr(1)), '<div class=\"job_seen_beacon\">', chr(1)), chr(1)))[2:26] AS a FROM pages))",
    f"parts AS (SELECT CAST(CAST(page_id AS HUGEINT) * 2147483648 + pos AS VARCHAR) AS ingest_seq, {_pick('c', '(<a [^>]*>)')} AS link, "
    f"{_text(_pick('c', '<a [^>]*>(.*?)</a>'))} AS title, {_pick('c', 'company-name' + chr(34) + '>(.*?)</span>')} AS co, "
    f"{_pick('c', 'text-location' + chr(34) + '>(.*?)</div>')} AS loc, {_pick('c', 'class=' + chr(34) + 'date' + chr(34) + '>(.*?)</span>')} AS age FROM cards)",
    "more AS (SELECT *, replace(regexp_extract(link, 'href=\"([^\"]*)\"', 1), '&amp;', '&') AS href, regexp_extract(link, 'data-jk=\"([^\"]*)\"', 1) AS jk, "
    "replace(regexp_extract(link, ' id=\"([^\"]*)\"', 1), 'job_', '') AS own FROM parts)",
    "SELECT ingest_seq, title, CASE WHEN co = '' THEN 'Unknown' ELSE co END AS company, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://www.indeed.com' || href END AS url, "
    "CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://www.indeed.com' || href END AS apply_url, split_part(loc, ',', 1) AS city, 'United States' AS country, "
    f"CASE WHEN jk <> '' THEN jk ELSE own END AS external_id, {level_sql(LEVELS['indeed'])} AS experience_level, {O.ts(relative_sql('age'))} AS posting_date "
    "FROM more WHERE link LIKE '%jcs-JobTitle%' OR link LIKE '%data-jk%'",
)


@register("src_indeed_cards", O.query(*_INDEED))
def _(spark, sf):
    found = sources.map_source(I.landing_of(spark, sf, "indeed"), "indeed", CFG)
    return found.select(_arrival(), *_CARD_COLUMNS[1:], seconds("posting_date"))


# --- all boards at once ----------------------------------------------------------------------

_N = len(I.LANDING_BOARDS)
_BRANCHES = " UNION ALL BY NAME ".join(
    f"(WITH {landed(b, f'(SELECT * FROM raw WHERE ingest_seq % {_N} = {i} AND ingest_seq % 37 <> 0)')} {JSON_MAPPINGS[b]})"
    for i, b in enumerate(I.LANDING_BOARDS)
)
UNION = f"all_boards AS ({_BRANCHES})"


@register("union_sources", O.query(O.RAW, UNION, f"{_AS_TEXT} all_boards").replace("WITH RECURSIVE", "WITH", 1))
def _(spark, sf):
    return tidy(sources.union_sources(I.landing(spark, sf), CFG))


@register(
    "quarantined",
    O.query(
        O.RAW, UNION, "SELECT ingest_seq FROM raw WHERE ingest_seq NOT IN (SELECT ingest_seq // 2147483648 FROM all_boards)"
    ).replace("WITH RECURSIVE", "WITH", 1),
)
def _(spark, sf):
    return sources.quarantined(I.landing(spark, sf), CFG).select("ingest_seq")


# Two boards are capped; here every other posting comes from one of them.
_CAPPED = "CASE ingest_seq % 4 WHEN 0 THEN 'linkedin' WHEN 2 THEN 'welcometothejungle' ELSE source END"


@register(
    "source_dedup_cap",
    O.query(
        O.RAW, f"b AS (SELECT {_CAPPED} AS src, external_id, min(ingest_seq) AS ingest_seq FROM raw GROUP BY ALL)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ingest_seq) AS rn FROM b)",
        "SELECT src AS source, external_id, ingest_seq FROM r WHERE rn <= CASE src WHEN 'linkedin' THEN 150 WHEN 'welcometothejungle' THEN 120 ELSE 1000000000 END",
    ),
)
def _(spark, sf):
    rows = I.postings(spark, sf).select(F.expr(_CAPPED).alias("source"), "external_id", "ingest_seq")
    return sources.dedup_and_cap(rows, replace(CFG, source_caps=SOURCE_CAPS)).select("source", "external_id", "ingest_seq")
