"""Queries: filters, joins, dedup, parsing, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirescope.functions import dates, numbers, text
from hirescope.operators import dedup, facets, filters, lookups, normalize, store, validate
from hirescope.operators.versions import Attempt
from hirescope.plans import discovery
from hirescope.schemas import BOOL, LONG, STRING, struct
from hirescope.session import materialize, scratch_path
from hirescope.sources.json_boards import country_from_location, graded_level_from_title, level_from_title
from workloads import inputs as I
from workloads import oracle as O
from workloads.registry import joined, register, seconds

CFG = I.CFG
SEQ_TITLE = ("ingest_seq", "title")


# --- filters ---------------------------------------------------------------------------

@register("filter_irrelevant", O.query(O.RAW, f"SELECT ingest_seq, title FROM raw WHERE NOT {O.IRRELEVANT}"))
def _(spark, sf):
    return filters.filter_irrelevant(I.postings(spark, sf), CFG).select(*SEQ_TITLE)


@register("filter_senior", O.query(O.RAW, f"SELECT ingest_seq, title FROM raw WHERE NOT {O.SENIOR}"))
def _(spark, sf):
    return filters.filter_senior(I.postings(spark, sf), CFG).select(*SEQ_TITLE)


@register("classify_role", O.query(O.RAW, f"SELECT ingest_seq, {O.ROLE} AS role_category FROM raw"))
def _(spark, sf):
    return filters.classify_role(I.postings(spark, sf), CFG).select("ingest_seq", "role_category")


@register("filter_entry_level", O.query(O.RAW, O.JUNIOR, "SELECT ingest_seq, title, role_category FROM junior"))
def _(spark, sf):
    return filters.filter_entry_level(I.postings(spark, sf), CFG).select(*SEQ_TITLE, "role_category")


@register("filter_location", O.query(O.RAW, f"SELECT ingest_seq, country FROM raw WHERE {O.REACH}"))
def _(spark, sf):
    return filters.filter_location(I.postings(spark, sf), CFG).select("ingest_seq", "country")


@register(
    "discovery_funnel",
    O.query(
        O.RAW, O.JUNIOR, *O.greedy("junior"),
        "SELECT (SELECT count(*) FROM raw) AS n_raw, (SELECT count(*) FROM junior) AS n_entry_level, "
        f"(SELECT count(*) FROM uniq) AS n_unique, (SELECT count(*) FROM uniq WHERE {O.REACH}) AS n_located",
    ),
)
def _(spark, sf):
    return discovery.discovery_funnel(I.postings(spark, sf), CFG)


@register(
    "facet_filter",
    O.query(
        O.RAW, O.parsed("raw"),
        f"SELECT ingest_seq, title, country, {O.ROLE} AS role_category, remote_type FROM parsed "
        f"WHERE country = 'United States' AND {O.ROLE} = 'customer_service' AND remote_type = 'hybrid'",
    ),
)
def _(spark, sf):
    parsed = filters.classify_role(normalize.parse_postings(I.postings(spark, sf), CFG), CFG)
    found = filters.facet_filter(
        parsed, country="United States", source="All", role_category="customer_service", remote_type="hybrid"
    )
    return found.select(*SEQ_TITLE, "country", "role_category", "remote_type")


def listing(spark, sf) -> facets.Listing:
    """The parsed postings, stored as a listing of two runs: sponsored ones and the rest."""
    root = scratch_path(spark, "listing")
    columns = (*facets.FACETS, "title", "company", "posting_date", "fingerprint", "ingest_seq", "visa_sponsorship")
    rows = filters.classify_role(normalize.parse_postings(I.postings(spark, sf), CFG), CFG).select(*columns)
    rows = materialize(rows, "listed")
    facets.add_listing(rows.where("visa_sponsorship"), root, "sponsored", slice_rows=20_000)
    facets.add_listing(rows.where("NOT coalesce(visa_sponsorship, false)"), root, "others", slice_rows=20_000)
    return facets.Listing(spark, root)


_FACET_ROWS = (
    f"seen AS (SELECT *, {O.ROLE} AS role FROM parsed)",
    "facet AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS facet, {c} AS value, country AS c, remote_type AS r FROM seen"
        for f, c in (("country", "country"), ("source", "source"), ("role_category", "role"), ("remote_type", "remote_type"))) + ")",
)


@register(
    "facet_counts",
    O.query(O.RAW, O.parsed("raw"), *_FACET_ROWS, "SELECT facet, value, count(*) AS n FROM facet WHERE value IS NOT NULL AND c = 'United States' "
            "AND r = 'hybrid' GROUP BY facet, value").replace("WITH RECURSIVE", "WITH"),
)
def _(spark, sf):
    return listing(spark, sf).facet_counts(country="United States", source="All", remote_type="hybrid")


@register(
    "facet_page",
    O.query(
        O.RAW, O.parsed("raw"),
        "SELECT row_number() OVER (ORDER BY posting_date DESC NULLS LAST, fingerprint, ingest_seq) AS rank, ingest_seq, title, company, source "
        "FROM parsed WHERE country = 'Remote' AND remote_type = 'remote' ORDER BY 1 LIMIT 100",
    ),
)
def _(spark, sf):
    page = listing(spark, sf).page(100, country="Remote", remote_type="remote")
    return page.select("rank", "ingest_seq", "title", "company", "source")


# --- joins and dedup ----------------------------------------------------------------------

@register(
    "join_company",
    O.query(
        O.RAW, "SELECT ingest_seq, company_id, coalesce(c_name, 'Unknown') AS company "
        "FROM raw LEFT JOIN customer ON c_custkey = company_id",
    ),
)
def _(spark, sf):
    slim = I.postings(spark, sf).select("ingest_seq", "company_id")
    return lookups.join_company(slim, I.companies(spark, sf))


# Stored rows: the labelled documents, under the plain document number.
_STORED_SQL = (
    "stored AS (SELECT 'src' || CAST(doc_id % 20 AS VARCHAR) AS source, CAST(doc_id AS VARCHAR) AS external_id, "
    "doc_id AS ingest_seq FROM labels)"
)


def stored_keys(spark, sf):
    return I.table(spark, sf, "labels").selectExpr(
        "'src' || CAST(doc_id % 20 AS STRING) AS source", "CAST(doc_id AS STRING) AS external_id", "doc_id AS ingest_seq"
    )


_NEW_SQL = (
    "fresh AS (SELECT * FROM raw r WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.source = r.source AND s.external_id = r.external_id) "
    "QUALIFY row_number() OVER (PARTITION BY r.source, r.external_id ORDER BY r.ingest_seq) = 1)"
)


@register("insert_new_jobs", O.query(O.RAW, _STORED_SQL, _NEW_SQL, "SELECT ingest_seq, source, external_id FROM fresh"))
def _(spark, sf):
    batch = I.postings(spark, sf).select("ingest_seq", "source", "external_id")
    return lookups.new_postings(batch, stored_keys(spark, sf), CFG)


@register(
    "keyword_join",
    O.query(
        O.RAW,
        "kw(priority, label, keyword) AS (VALUES "
        + ", ".join(
            f"({i}, '{role}', {O.lit(w)})" for i, (role, words) in enumerate(O.fv.ROLE_KEYWORDS.items()) for w in words
        )
        + ")",
        "SELECT DISTINCT ingest_seq, CAST(priority AS INT) AS priority, label FROM raw JOIN kw ON contains(lower(title), keyword)",
    ),
)
def _(spark, sf):
    rows = [(i, role, w) for i, (role, words) in enumerate(CFG.role_keywords.items()) for w in words]
    keywords = spark.createDataFrame(rows, "priority INT, label STRING, keyword STRING")
    return lookups.keyword_matches(I.postings(spark, sf), "title", keywords, ("ingest_seq",))


_OWN_KEYWORD = "lower(substr(text, 1 + CAST(doc_id % 40 AS INT), 2 + CAST(doc_id % 9 AS INT)))"


@register("keyword_join_large", O.query(
    O.RAW, f"kw AS (SELECT DISTINCT {_OWN_KEYWORD} AS keyword FROM documents)",
    "SELECT ingest_seq, keyword AS label, 0 AS priority FROM raw JOIN kw ON keyword <> '' AND contains(lower(description), keyword)"))
def _(spark, sf):
    """As many keywords as documents, 2 to 10 characters from each text, sought in all descriptions."""
    own = I.table(spark, sf, "documents").selectExpr(f"{_OWN_KEYWORD} AS keyword").where("keyword IS NOT NULL")
    keywords = own.selectExpr("keyword", "keyword AS label", "0 AS priority")
    return lookups.containment_join(I.postings(spark, sf), "description", keywords, ("ingest_seq",))


@register(
    "dedup_postings",
    O.query(O.RAW, *O.greedy("raw"), "SELECT ingest_seq, source, external_id, title, company FROM uniq"),
)
def _(spark, sf):
    slim = I.postings(spark, sf).select("ingest_seq", "source", "external_id", "title", "company")
    return dedup.dedup_postings(slim)


@register(
    "company_upsert",
    O.query(
        O.RAW,
        "stored AS (SELECT lower(c_name) AS normalized_name, c_name AS name, CAST(0 AS BIGINT) AS first_seq FROM customer "
        "UNION ALL SELECT 'company 3', 'Company 3', CAST(0 AS BIGINT))",
        "named AS (SELECT ingest_seq, company, lower(" + O.strip("company") + ") AS k FROM raw WHERE company <> '')",
        "SELECT normalized_name, name, first_seq FROM stored UNION ALL SELECT k, min_by(company, ingest_seq), min(ingest_seq) "
        "FROM named WHERE k NOT IN (SELECT normalized_name FROM stored) GROUP BY k",
    ).replace("WITH RECURSIVE", "WITH"),
)
def _(spark, sf):
    stored = (
        I.table(spark, sf, "customer")
        .selectExpr("lower(c_name) AS normalized_name", "c_name AS name", "0L AS first_seq")
        .unionByName(spark.sql("SELECT 'company 3' AS normalized_name, 'Company 3' AS name, 0L AS first_seq"))
    )
    return dedup.company_upsert(I.postings(spark, sf), stored)


@register(
    "distinct_terms",
    "SELECT min_by(t, p_partkey) AS term, min(p_partkey) AS first_seen FROM "
    "(SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE p_type END AS t FROM part) GROUP BY lower(t)",
)
def _(spark, sf):
    terms = I.table(spark, sf, "part").selectExpr(
        "p_partkey AS first_seen", "CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE p_type END AS term"
    )
    return dedup.distinct_terms(terms, "term", "first_seen")


# --- projections ----------------------------------------------------------------------------

@register("fingerprint", O.query(O.RAW, "SELECT ingest_seq, md5(source || ':' || external_id) AS fingerprint FROM raw"))
def _(spark, sf):
    fp = text.fingerprint(F.col("source"), F.col("external_id"))
    return I.postings(spark, sf).select("ingest_seq", fp.alias("fingerprint"))


@register("clean_title", O.query(O.RAW, f"SELECT ingest_seq, {O.CLEAN_TITLE} AS title FROM raw"))
def _(spark, sf):
    return I.postings(spark, sf).select("ingest_seq", normalize.clean_title(F.col("title")).alias("title"))


@register("normalize_title", O.query(O.RAW, f"SELECT ingest_seq, {O.normalized('title')} AS normalized_title FROM raw"))
def _(spark, sf):
    return I.postings(spark, sf).select("ingest_seq", normalize.normalize_title(F.col("title")).alias("normalized_title"))


@register("clean_company", O.query(O.RAW, f"SELECT ingest_seq, {O.CLEAN_COMPANY} AS company FROM raw"))
def _(spark, sf):
    return I.postings(spark, sf).select("ingest_seq", normalize.clean_company(F.col("company")).alias("company"))


@register("normalize_country", O.query(O.RAW, f"SELECT ingest_seq, {O.COUNTRY} AS country FROM raw"))
def _(spark, sf):
    return I.postings(spark, sf).select("ingest_seq", normalize.normalize_country(F.col("country")).alias("country"))


@register("normalize_level", O.query(O.RAW, f"SELECT ingest_seq, {O.LEVEL} AS experience_level FROM raw"))
def _(spark, sf):
    level = normalize.normalize_level(F.col("experience_level"))
    return I.postings(spark, sf).select("ingest_seq", level.alias("experience_level"))


@register(
    "normalize_employment",
    O.query(O.RAW, f"SELECT ingest_seq, CASE WHEN employment_type IS NOT NULL THEN {O.EMPLOYMENT} END AS employment_type FROM raw"),
)
def _(spark, sf):
    kind = normalize.normalize_employment(F.col("employment_type"))
    return I.postings(spark, sf).select("ingest_seq", kind.alias("employment_type"))


@register("summarize", O.query(O.RAW, f"SELECT ingest_seq, {O.SUMMARY} AS description_summary FROM raw"))
def _(spark, sf):
    summary = normalize.summarize(F.col("description"))
    return I.texts(spark, sf).select("ingest_seq", summary.alias("description_summary"))


@register(
    "summarize_pages",
    "SELECT page_id, " + O.SUMMARY.replace("description", "html") + " AS summary FROM pages",
)
def _(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", normalize.summarize(F.col("html")).alias("summary"))


@register(
    "parse_defaults",
    O.query(
        O.RAW, f"SELECT ingest_seq, {O.APPLY} AS apply_url, coalesce(city, '') AS city, "
        "md5(coalesce(description, '')) AS description_md5 FROM raw",
    ),
)
def _(spark, sf):
    filled = normalize.with_defaults(I.postings(spark, sf))
    return filled.select("ingest_seq", "apply_url", "city", F.md5("description").alias("description_md5"))


_PARSED_COLUMNS = (
    "ingest_seq", "source", "external_id", "title", "normalized_title", "company", "url", "apply_url", "country", "city",
    "remote_type", "salary_min", "salary_max", "salary_currency", "experience_level", "employment_type",
    "visa_sponsorship", "international_hiring", "relocation_support", "fingerprint", "description_summary",
)


@register(
    "parse_postings",
    O.query(
        O.RAW, O.parsed("raw", summary=True),
        f"SELECT {', '.join(_PARSED_COLUMNS)}, md5(description) AS description_md5, {O.ts('posting_date')} AS posting_date FROM parsed",
    ),
)
def _(spark, sf):
    parsed = normalize.parse_postings(I.texts(spark, sf), CFG)
    return parsed.select(*_PARSED_COLUMNS, F.md5("description").alias("description_md5"), seconds("posting_date"))


# --- scalar parsing on derived text ------------------------------------------------------------

_ISO_SQL = (
    "CASE WHEN regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN try_strptime(t, '%Y-%m-%d') "
    "WHEN t LIKE '%+02:00' THEN try_strptime(replace(t, '+02:00', ''), '%Y-%m-%dT%H:%M:%S') - INTERVAL 2 HOUR "
    "WHEN t LIKE '%Z' THEN try_strptime(t, '%Y-%m-%dT%H:%M:%SZ') "
    "WHEN t LIKE '%.___' THEN try_strptime(t, '%Y-%m-%dT%H:%M:%S.%g') END"
)


def iso_sql(t: str) -> str:
    return f"(SELECT {_ISO_SQL} FROM (SELECT {t} AS t))"


@register("date_iso", O.query(O.RAW, f"SELECT ingest_seq, {O.ts(iso_sql(I.duck_rule(I._ISO)))} AS posting_date FROM raw"))
def _(spark, sf):
    rows = I.postings(spark, sf).selectExpr("ingest_seq", f"{I.spark_rule(I._ISO)} AS t")
    return rows.select("ingest_seq", dates.parse_iso(F.col("t")).alias("posting_date")).select("ingest_seq", seconds("posting_date"))


def relative_sql(t: str) -> str:
    return (
        "(SELECT CASE WHEN n <> '' THEN make_timestamp(" + str(I.AS_OF_MICROS) + " - CAST(n AS BIGINT) * 1000000 * "
        "CASE WHEN contains(t, 'minute') THEN 60 WHEN contains(t, 'hour') THEN 3600 WHEN contains(t, 'day') THEN 86400 "
        f"WHEN contains(t, 'week') THEN 604800 ELSE 0 END) END FROM (SELECT t, regexp_extract(t, '[0-9]+') AS n FROM (SELECT lower({t}) AS t)))"
    )


@register("date_relative", O.query(O.RAW, f"SELECT ingest_seq, {O.ts(relative_sql(I.duck_rule(I._AGE)))} AS posting_date FROM raw"))
def _(spark, sf):
    rows = I.postings(spark, sf).selectExpr("ingest_seq", f"{I.spark_rule(I._AGE)} AS t")
    moment = dates.parse_relative(F.col("t"), dates.as_timestamp(I.AS_OF))
    return rows.select("ingest_seq", moment.alias("posting_date")).select("ingest_seq", seconds("posting_date"))


SALARY_SQL = {
    "salary_min": "TRY_CAST(list_extract(regexp_extract_all(replace({t}, ',', ''), '[0-9]+'), 1) AS INT)",
    "salary_max": "TRY_CAST(list_extract(regexp_extract_all(replace({t}, ',', ''), '[0-9]+'), 2) AS INT)",
    "salary_currency": "CASE WHEN regexp_matches({t}, '[0-9]') THEN CASE WHEN contains({t}, '$') OR contains({t}, 'USD') THEN 'USD' "
    "WHEN contains({t}, '€') OR contains({t}, 'EUR') THEN 'EUR' WHEN contains({t}, '£') OR contains({t}, 'GBP') THEN 'GBP' ELSE 'USD' END END",
}


@register(
    "salary_parse",
    O.query(
        O.RAW, f"pay AS (SELECT ingest_seq, {I.duck_rule(I._PAY)} AS t FROM raw)",
        "SELECT ingest_seq, " + ", ".join(f"{e.format(t='t')} AS {c}" for c, e in SALARY_SQL.items()) + " FROM pay",
    ),
)
def _(spark, sf):
    rows = I.postings(spark, sf).selectExpr("ingest_seq", f"{I.spark_rule(I._PAY)} AS t")
    return rows.select("ingest_seq", numbers.salary_range(F.col("t")).alias("p")).select("ingest_seq", "p.*")


def country_sql(t: str) -> str:
    named = O.case_of(f"lower({t})", O.fv.LOCATION_COUNTRIES, "'Remote'", test="contains({c}, {k})")
    return f"CASE WHEN {t} = '' OR contains(lower({t}), 'remote') THEN 'Remote' ELSE {named} END"


@register(
    "country_from_location",
    O.query(
        O.RAW, f"place AS (SELECT ingest_seq, {I.duck_rule(I._PLACE)} AS t FROM raw)",
        f"SELECT ingest_seq, t AS location, {country_sql('t')} AS country FROM place",
    ),
)
def _(spark, sf):
    rows = I.postings(spark, sf).selectExpr("ingest_seq", f"{I.spark_rule(I._PLACE)} AS location")
    return rows.withColumn("country", country_from_location(F.col("location")))


def level_sql(words) -> str:
    return f"CASE WHEN {O.any_of('lower(title)', words)} THEN 'Senior' ELSE 'Entry-Level' END"


GRADED_SQL = O.ordered("lower(title)", O.fv.REMOTEOK_LEVEL_WORDS) + " ELSE 'Entry-Level' END"


@register(
    "level_from_title",
    O.query(
        O.RAW, "SELECT ingest_seq, " + ", ".join(f"{level_sql(w)} AS {s}" for s, w in O.fv.LEVEL_WORDS.items())
        + f", {GRADED_SQL} AS remoteok FROM raw",
    ),
)
def _(spark, sf):
    title = F.col("title")
    levels = [level_from_title(title, s).alias(s) for s in O.fv.LEVEL_WORDS]
    return I.postings(spark, sf).select("ingest_seq", *levels, graded_level_from_title(title).alias("remoteok"))


# --- validation --------------------------------------------------------------------------------

@register("scam_score", O.query(O.RAW, f"SELECT ingest_seq, {O.SCAM} AS scam_score FROM raw"))
def _(spark, sf):
    return I.texts(spark, sf).select("ingest_seq", validate.scam_score(CFG).alias("scam_score"))


@register("url_score", O.query(O.RAW, f"SELECT ingest_seq, {O.URL} AS url_score FROM raw"))
def _(spark, sf):
    return I.postings(spark, sf).select("ingest_seq", validate.url_score(F.col("url")).alias("url_score"))


@register("freshness_score", O.query(O.RAW, f"SELECT ingest_seq, {O.FRESH} AS freshness_score FROM raw"))
def _(spark, sf):
    return I.postings(spark, sf).select(
        "ingest_seq", validate.freshness_score(F.col("posting_date"), CFG).alias("freshness_score")
    )


@register("completeness", O.query(O.RAW, f"SELECT ingest_seq, {O.COMPLETE} AS completeness FROM raw"))
def _(spark, sf):
    return I.postings(spark, sf).select("ingest_seq", validate.completeness().alias("completeness"))


@register("staffing_flag", O.query(O.RAW, f"SELECT ingest_seq, {O.STAFFING} AS is_staffing FROM raw"))
def _(spark, sf):
    return I.texts(spark, sf).select("ingest_seq", validate.staffing_flag(CFG).alias("is_staffing"))


@register(
    "validate_postings",
    O.query(
        O.RAW, O.parsed("raw"), *O.validated("parsed"),
        "SELECT ingest_seq, score >= 0.5 AND len(reasons) = 0 AS is_valid, round_even(score, 3) AS validation_score, "
        "array_to_string(reasons, '|') AS reasons FROM checked",
    ),
)
def _(spark, sf):
    checked = validate.validate_postings(normalize.parse_postings(I.texts(spark, sf), CFG), CFG)
    return checked.select("ingest_seq", "is_valid", "validation_score", joined("reasons"))


@register(
    "rejection_report",
    O.query(
        O.RAW, O.parsed("raw"), *O.validated("parsed"),
        "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM checked) GROUP BY reason",
    ),
)
def _(spark, sf):
    return validate.rejection_report(validate.validate_postings(normalize.parse_postings(I.texts(spark, sf), CFG), CFG))


# --- store ----------------------------------------------------------------------------------------

@register(
    "store_jobs",
    O.query(
        O.RAW, O.parsed("raw"), *O.validated("parsed"), _STORED_SQL,
        "good AS (SELECT * FROM checked WHERE len(reasons) = 0)", _NEW_SQL.replace("FROM raw r", "FROM good r"),
        f"SELECT ingest_seq, source, external_id, title, nullif(lower({O.strip('company')}), '') AS company_id, "
        "coalesce(strftime(posting_date, '%Y-%m'), 'unknown') AS posting_month, TRUE AS is_validated FROM fresh",
    ),
)
def _(spark, sf):
    parsed = normalize.parse_postings(I.texts(spark, sf), CFG)
    good = validate.accepted(validate.validate_postings(parsed, CFG))
    # As in a run: the validated batch is a table before it is compared with the stored keys.
    batch = materialize(good, "store-batch")
    root = scratch_path(spark, "store")
    earlier = stored_keys(spark, sf).withColumn("posting_month", F.lit("unknown"))
    first = Attempt(spark, root, "r0", "store")
    first.write(earlier, "jobs", "posting_month")
    first.commit()
    store.store_run(batch, root, "r1", CFG)
    columns = struct(ingest_seq=LONG, source=STRING, external_id=STRING, title=STRING, company_id=STRING, posting_month=STRING,
                     is_validated=BOOL, run_id=STRING)
    return store.read_table(spark, root, "jobs", columns).where("run_id = 'r1'").drop("run_id")


_OLD_ROLE = "CASE ingest_seq % 4 WHEN 0 THEN 'analytics' WHEN 1 THEN 'customer_service' END"


@register(
    "backfill_role",
    O.query(
        O.RAW, O.parsed("raw"),
        f"SELECT ingest_seq, coalesce({O.ROLE}, old_role) AS role_category, {O.ROLE} IS NOT NULL AND {O.ROLE} IS DISTINCT FROM old_role AS role_changed "
        f"FROM (SELECT *, {_OLD_ROLE} AS old_role FROM parsed)",
    ),
)
def _(spark, sf):
    root = scratch_path(spark, "backfilled")
    stored = normalize.parse_postings(I.postings(spark, sf), CFG).withColumn("role_category", F.expr(_OLD_ROLE))
    first = Attempt(spark, root, "r1", "store")
    first.write(stored.withColumn("posting_month", F.lit("unknown")), "jobs", "posting_month")
    before = first.commit().version
    store.backfill_table(spark, root, "r1", CFG)
    columns = struct(ingest_seq=LONG, role_category=STRING)
    old = store.read_table(spark, root, "jobs", columns, version=before).withColumnRenamed("role_category", "_old")
    changed = ~F.col("role_category").eqNullSafe(F.col("_old"))
    return store.read_table(spark, root, "jobs", columns).join(old, "ingest_seq").withColumn("role_changed", changed).drop("_old")


@register(
    "add_columns",
    "SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS role_category, CAST(NULL AS INT) AS employee_count FROM customer",
)
def _(spark, sf):
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL("c_name STRING, role_category STRING, employee_count INT")
    once = store.add_columns(I.table(spark, sf, "customer").select("c_custkey", "c_name"), wanted)
    return store.add_columns(once, wanted)


@register(
    "active_listings",
    O.query(
        O.RAW,
        "SELECT ingest_seq, company_id, title, coalesce(c_name, 'Unknown') AS company, CASE WHEN coalesce(country, '') = '' THEN 'Remote' ELSE country END AS country, "
        "coalesce(city, '') AS city, remote_type, CASE WHEN coalesce(experience_level, '') = '' THEN 'Entry-Level' ELSE experience_level END AS experience_level, "
        "'uncategorized' AS role_category, salary_min, salary_max, visa_sponsorship, source, " + O.ts("posting_date") + " AS posting_date, url "
        "FROM raw LEFT JOIN customer ON c_custkey = company_id WHERE ingest_seq % 9 <> 4 AND ingest_seq % 14 <> 3",
    ),
)
def _(spark, sf):
    jobs = I.postings(spark, sf).withColumns(
        {"is_active": F.expr("ingest_seq % 9 <> 4"), "is_duplicate": F.expr("ingest_seq % 14 = 3")}
    )
    listed = lookups.active_listings(jobs, I.companies(spark, sf))
    return listed.withColumn("posting_date", seconds("posting_date"))
