"""Single operators on a few literal rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import AS_OF, column
from hirescope.catalog import project_catalog
from hirescope.config import Config, Profile
from hirescope.functions import dates, numbers, text
from hirescope.operators import analytics, answers, export, filters, lookups, normalize, recommend, skills, validate


def names_of(df, cfg):
    return column(skills.extract_skill_names(df, cfg), "skill_names")


def test_clean_title(make):
    titles = ["Data Analyst - Remote", "Junior Python Developer (Remote)", "\t Analyst ", "Analyst – full time, x",
              "A (b) and (c)", "Dev (x)\n", None, "", "Back-end Remote Dev"]
    got = column(make(*[{"title": t} for t in titles]).withColumn("c", normalize.clean_title(F.col("title"))), "c")
    assert got == ["Data Analyst", "Junior Python Developer", "Analyst", "Analyst", "A", "Dev", "", "", "Back-end Remote Dev"]


def test_normalize_title(make):
    titles = ["Junior Data Analyst", "Senior Python Developer", "Sr. Jr Lead Engineer", "Deadlead Analyst"]
    got = column(make(*[{"title": t} for t in titles]).withColumn("c", normalize.normalize_title(F.col("title"))), "c")
    assert got == ["data analyst", "python developer", "engineer", "deadanalyst"]


def test_company_country_level_employment(make, cfg):
    rows = [
        {"company": "Acme, Inc.", "country": "UK ", "experience_level": "Mid-Senior", "employment_type": "Full-Time"},
        {"company": "AcmeInc", "country": None, "experience_level": None, "employment_type": "Part time contract"},
        {"company": "Acme LLC", "country": "  ", "experience_level": " Lead", "employment_type": "Internship"},
        {"company": "Acme, Ltd", "country": "Deutschland", "experience_level": "intern, senior", "employment_type": "Volunteer"},
        {"company": "acme, inc", "country": "Spain", "experience_level": "x", "employment_type": None},
    ]
    parsed = normalize.parse_postings(make(*rows), cfg)
    assert column(parsed, "company") == ["Acme", "Acme", "Acme LLC", "Acme"]
    assert column(parsed, "country") == ["United Kingdom", "Remote", "", "Germany"]
    assert column(parsed, "experience_level") == ["Mid-Level", "Entry-Level", "Senior", "Entry-Level"]
    assert column(parsed, "employment_type") == ["full_time", "part_time", "internship", "unknown"]
    assert column(normalize.unparseable(make(*rows)), "ingest_seq") == [4]


def test_summary_and_defaults(make, cfg):
    rows = [
        {"description": "<p>Hello  <b>World</b></p>\n", "url": "u", "apply_url": ""},
        {"description": "x" * 500, "url": "u", "apply_url": "a"},
        {"description": "é" * 501},
        {"description": None},
    ]
    parsed = normalize.parse_postings(make(*rows), cfg)
    assert column(parsed, "description_summary") == ["Hello World", "x" * 500, "é" * 500 + "...", ""]
    assert column(parsed, "apply_url")[:2] == ["u", "a"]
    assert column(parsed, "role_category") == [None] * 4
    kept = normalize.parse_postings(make({"title": "x", "role_category": "business_development"}), cfg)
    assert column(kept, "role_category") == ["business_development"]


def test_roles_and_filters(make, cfg):
    titles = ["Junior Data Analyst", "Customer Service Representative", "Business Development Analyst",
              "Sales Development Representative", "Plumber", None]
    assert column(filters.classify_role(make(*[{"title": t} for t in titles]), cfg), "role_category") == [
        "analytics", "customer_service", "business_development", "business_development", None, None]
    rows = [
        {"title": "Customer Service Representative", "experience_level": "Entry-Level"},
        {"title": "Customer Success Associate"},
        {"title": "Senior Data Engineer", "experience_level": "Senior"},
        {"title": "Head of Customer Service", "experience_level": "Entry-Level"},
        {"title": "Warehouse Operative", "experience_level": "Entry-Level"},
        {"title": "Graphic Designer", "experience_level": "Entry-Level"},
        {"title": "CSR Agent", "experience_level": "Entry-Level"},        # "sr " hides in "csr "
        {"title": "International Data Analyst"},                          # "intern"
        {"title": "Data Analyst"},
    ]
    kept = filters.filter_entry_level(make(*rows), cfg)
    assert column(kept, "ingest_seq") == [0, 1, 7]
    assert all(column(kept, "role_category"))
    strict = Config(as_of=AS_OF, word_boundaries=True)
    assert column(filters.filter_entry_level(make(*rows), strict), "ingest_seq") == [0, 1, 6]


def test_location(make, cfg):
    places = ["uk", "Deutschland", "Reunion", "Japan", None, "", "London, United Kingdom", "Worldwide"]
    df = make(*[{"country": p} for p in places])
    assert column(filters.filter_location(df, cfg), "country") == ["Deutschland", "Reunion", "London, United Kingdom", "Worldwide"]
    first = Config(as_of=AS_OF, normalize_location_first=True)
    assert column(filters.filter_location(df, first), "ingest_seq") == [0, 1, 2, 4, 5, 6, 7]


def test_facets(make):
    df = make({"country": "A", "source": "x"}, {"country": "B", "source": "x"})
    assert filters.facet_filter(df, country="A", source="All", role_category=None).count() == 1
    assert [r[0] for r in filters.facet_values(df, "country").collect()] == ["A", "B"]


def test_validation(make, cfg):
    day = timedelta(days=1)
    rows = [
        {"title": "Make Money Fast - Work From Home", "description": "Earn $5000 per day with no experience needed", "url": "https://example.com"},
        {"title": "Data Analyst", "company": "G", "url": "https://careers.google.com/jobs/123", "description": "SQL", "country": "US", "posting_date": AS_OF},
        {"title": "A", "company": "Best Staffing", "url": "ftp://x", "posting_date": AS_OF - 29 * day},
        {"title": "A", "company": "C", "url": "http://x1"},
        {"title": None, "company": None, "url": None, "description": "wire transfer"},
    ]
    got = {r["ingest_seq"]: r for r in validate.validate_postings(make(*rows), cfg).collect()}
    assert not got[0]["is_valid"] and got[0]["reasons"] == ["scam_indicators"]
    assert got[0]["validation_score"] == 0.1  # 1 - 3 * 0.3, rounded to 3
    assert got[1]["is_valid"] and got[1]["validation_score"] == 1.0 and got[1]["reasons"] == []
    assert got[2]["reasons"] == ["invalid_url", "too_old", "staffing_agency"] and got[2]["validation_score"] == 0.3
    assert got[3]["reasons"] == ["invalid_url"] and not got[3]["is_valid"]  # nine characters score 0.2
    assert got[4]["reasons"] == ["invalid_url", "incomplete_data"]
    report = {r["reason"]: r["n"] for r in validate.rejection_report(validate.validate_postings(make(*rows), cfg)).collect()}
    assert report == {"scam_indicators": 1, "invalid_url": 3, "too_old": 1, "staffing_agency": 1, "incomplete_data": 1}


def test_freshness_edges(make, cfg):
    ages = [timedelta(days=14, hours=23), timedelta(days=15), timedelta(days=28, hours=23), timedelta(days=29), timedelta(days=-3)]
    df = make(*[{"posting_date": AS_OF - a} for a in ages], {"posting_date": None})
    got = column(df.withColumn("s", validate.freshness_score(F.col("posting_date"), cfg)), "s")
    assert got == [1.0, 0.5, 0.5, 0.1, 1.0, 0.5]


def test_skills(make, cfg):
    df = make(
        {"title": "", "description": "Looking for Python, SQL, and Tableau experience"},
        {"title": "", "description": "Experience with Salesforce and Zendesk; strong lead generation and CSAT focus"},
        {"title": "Für R", "description": "C++ / C# and c++17"},
        {"title": None, "description": None},
        {"title": "x", "description": "b2b sales development; data pipeline management; voice of customer success; SQL Server"},
    )
    got = names_of(df, cfg)
    assert got[0] == ["python", "sql", "tableau"]
    assert got[1] == ["csat", "lead generation", "salesforce", "zendesk"]
    assert got[2] == ["c++", "r"]  # a term ending in a symbol needs a word character after it
    assert got[3] == []
    assert got[4] == ["b2b sales", "customer success", "data pipeline", "pipeline management", "sales development",
                      "sql", "sql server", "voice of customer"]
    loose = Config(as_of=AS_OF, symbol_terms_match=True)
    assert names_of(df, loose)[2] == ["c#", "c++", "r"]


def test_skill_details(make, cfg):
    df = make({"title": "x", "description": "SQL sql python.\nRequired: Python\nsql"}, {"title": "required go", "description": "api"})
    first, second = column(skills.extract_skills(df, cfg), "skills")
    assert [tuple(s) for s in first] == [("sql", "database", False, 3), ("python", "programming", True, 2)]
    assert [tuple(s) for s in second] == [("api", "technical", True, 1), ("go", "technical", True, 1)]


def test_skill_dimension_and_bridge(make, cfg):
    df = make(
        {"external_id": "1", "title": "required sql", "description": ""},
        {"external_id": "1", "title": "sql sql", "description": ""},
        {"external_id": "2", "title": "sql", "description": ""},
    )
    bridge = skills.job_skills_bridge(normalize.parse_postings(df, cfg), cfg)
    assert sorted((r["is_required"], r["count"]) for r in bridge.collect()) == [(False, 1), (True, 1)]
    assert [tuple(r) for r in skills.skill_dimension(bridge).collect()] == [("sql", "database", 2)]


def test_answers(spark, make, cfg):
    contents = [
        '{"skills":[{"name":"Salesforce","category":"business","is_required":true},{"name":"CSAT"}]}',
        'Here: {"skills": ["Python", {"name": "python"}]} bye', "broken {", '{"skills": []}', '[{"category": "x"}]', None,
        '["dbt", ""]', "5", '{"skills":[{"name":"x","is_required":"yes"},{"name":"y","is_required":0}]}',
    ]
    df = spark.createDataFrame(list(enumerate(contents)), "i INT, content STRING")
    got = column(df.withColumn("s", answers.parse_answer(F.col("content"), cfg)), "s", "i")
    assert [tuple(x) for x in got[0]] == [("salesforce", "business", True, 1), ("csat", "cx_metric", False, 1)]
    assert [x["name"] for x in got[1]] == ["python"]
    assert got[2] is None and got[3] is None and got[4] is None and got[5] is None and got[7] is None
    assert [tuple(x) for x in got[6]] == [("dbt", "transformation", False, 1)]
    assert [x["is_required"] for x in got[8]] == [True, False]

    posts = make({"title": "Python SQL", "description": ""}, {"title": "Excel", "description": ""}).withColumn("text_hash", answers.text_hash())
    # Of several usable answers to one text the first in order of arrival counts.
    given = spark.createDataFrame([(0, "broken"), (1, '["dbt"]'), (2, '["airflow"]')], "answer_seq INT, content STRING")
    landed = given.join(posts.where("ingest_seq = 0").select("text_hash"))
    merged = answers.skills_from_answers(skills.extract_skills(posts, cfg), landed, cfg)
    assert [[s["name"] for s in row] for row in column(merged, "skills")] == [["dbt"], ["excel"]]


def test_summary(make):
    rows = [
        {"company": "Google", "country": "US", "remote_type": "remote", "visa_sponsorship": True},
        {"company": "Meta", "country": "UK", "remote_type": "hybrid", "visa_sponsorship": False},
    ]
    assert tuple(analytics.summary_stats(make(*rows)).first()) == (2, 2, 2, 50.0, 1)
    assert analytics.summary_stats(make(*rows), approximate=True).first()["unique_companies"] == 2
    assert analytics.company_hiring(make()).count() == 0


def test_salary_statistics(make):
    values = [(30000, 50000), (-5, None), (70000, 200000), (70001, 65536), (None, None), (65535, None)]
    df = make(*[{"salary_min": a, "salary_max": b} for a, b in values])
    got = {r["bound"]: (r["mean"], r["median"], r["min"], r["max"]) for r in analytics.salary_analysis(df).collect()}
    assert got == {"min_salary": (47106.0, 65535.0, -5, 70001), "max_salary": (105179.0, 65536.0, 50000, 200000)}
    assert analytics.salary_analysis(make({})).count() == 0


def test_skill_gap_counts_profile_skills(make, cfg):
    names = skills.explode_names(skills.extract_skill_names(make({"title": "sql python"}, {"title": "sql"}), cfg))
    gap = analytics.skill_gap(skills.skill_frequency(names), Profile(("SQL", "excel", "juggling")))
    rows = {r["skill"]: r for r in gap.collect()}
    assert rows["sql"]["status"] == "covered" and rows["python"]["missing_rank"] == 1
    assert rows["sql"]["skill_coverage"] == 150.0 and rows["sql"]["matched_coverage"] == 50.0
    recs = [r["recommendation"] for r in analytics.learning_recs(gap).collect()]
    assert recs == ["python: Take Python for Data Science on DataCamp or Coursera"]


def test_matching(make, cfg):
    rows = [
        {"title": "Data Analyst", "description": "SQL Python Tableau Excel", "experience_level": "Entry-Level", "visa_sponsorship": True},
        {"title": "Chef", "description": "", "experience_level": "Senior"},
        {"title": "Dev", "description": "Java dbt", "experience_level": "Senior"},
    ]
    df = skills.extract_skill_names(make(*rows), cfg)
    got = {r["ingest_seq"]: r for r in recommend.match_jobs(df, Profile(("sql", "python", "Excel"), 1)).collect()}
    assert (got[0]["match_score"], got[0]["interview_readiness"], got[0]["application_success_prob"]) == (90.0, 100.0, 93.0)
    assert got[0]["missing_skills"] == ["tableau"] and got[0]["strengths"] == ["excel", "python", "sql"]
    assert got[0]["learning_recs"] == ["tableau: Create a public Tableau portfolio with 5+ dashboards"]
    assert len(got[0]["resume_improvements"]) == 2 and len(got[2]["resume_improvements"]) == 3
    assert got[1]["match_score"] == 50.0 and got[2]["match_score"] == 0.0
    ranked = recommend.rank_matches(recommend.match_jobs(df, Profile(("sql",), 9)), 2)
    assert column(ranked, "ingest_seq", "rank") == [1, 0]


def test_terms_after_letters_beyond_the_bmp(spark, make, cfg):
    posts = make({"title": "\U0001d7d8sql", "description": "\U00020000kafka"}, {"title": "\U0001f600sql", "description": "c++\U0001d7d8"})
    assert column(skills.extract_skill_names(posts, cfg), "skill_names") == [[], ["c++", "sql"]]


def test_projects_follow_role(spark, make, cfg):
    catalog = project_catalog(spark)
    posts = make({"title": "Customer Support Specialist", "description": "zendesk csat", "role_category": "customer_service"})
    demand = skills.skill_demand(skills.explode_names(skills.extract_skill_names(posts, cfg)))
    done = recommend.recommend_projects(catalog, posts, demand, Profile(("excel",)))
    assert set(column(done, "role_category", "rank")) == {"customer_service"}
    first = done.orderBy("rank").first()
    assert first["market_demand_score"] == 1 and first["skills_you_have"] == ["excel"]
    explicit = recommend.recommend_projects(catalog, make(), demand, Profile(("excel",)), "business_development")
    assert set(column(explicit, "role_category", "rank")) == {"business_development"}
    target = recommend.rec_categories(posts, Profile((), target_role="analytics"))
    assert [r[0] for r in target.collect()] == ["analytics"]
    assert [r[0] for r in recommend.rec_categories(make(), Profile(())).collect()] == ["analytics"]


def test_exports(spark, make, tmp_path):
    df = make({"title": 'a "quoted"\nline, x', "description": "", "posting_date": AS_OF}, {"title": None}).select("ingest_seq", "title", "description", "posting_date")
    path = export.export_csv(df, str(tmp_path / "csv"))
    want = df.withColumn("description", F.nullif("description", F.lit("")))  # CSV has no empty text
    assert sorted(map(tuple, export.read_csv(spark, path, df.schema).collect())) == sorted(map(tuple, want.collect()))
    export.export_json(df, str(tmp_path / "json"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "json")).count() == 2
    written = export.export_bundle({"Jobs": df, "None": df.where("false")}, str(tmp_path / "b"))
    assert list(written) == ["Jobs"]
    assert dict(spark.read.parquet(written["Jobs"]).dtypes)["posting_date"] == "timestamp_ntz"


def test_scalars(spark):
    def one(c):
        return spark.range(1).select(c.alias("c")).first()["c"]

    lit = F.lit
    assert one(text.fingerprint(lit("test"), lit("123"))) == one(text.fingerprint(lit("test"), lit("123")))
    assert one(text.title_case(lit("booking-holding o'neil 3m"))) == "Booking-Holding O'Neil 3M"
    assert one(text.strip(lit("\t 　x y\n\x1f"))) == "x y"
    assert one(text.element_text(lit("<b> a &amp; b </b>\n<i> c</i>"))) == "a & bc"
    for good, want in [
        ("2024-01-05", datetime(2024, 1, 5)), ("2024-01-05T10:00:00Z", datetime(2024, 1, 5, 10)),
        ("2024-01-05T10:00:00+02:00", datetime(2024, 1, 5, 8)), ("2024-01-05 10:00:00.5", datetime(2024, 1, 5, 10, 0, 0, 500000)),
        ("2024-01-05T10:00:00-0530", datetime(2024, 1, 5, 15, 30)), ("2024-01-05T10:00", datetime(2024, 1, 5, 10)),
    ]:
        assert one(F.date_format(dates.parse_iso(lit(good)), "yyyy-MM-dd HH:mm:ss.SSS")) == want.strftime("%Y-%m-%d %H:%M:%S.") + f"{want.microsecond // 1000:03d}", good
    for bad in ("2024", "2024-13-01", "yesterday", "", "2024-01-05 noon", None):
        assert one(dates.parse_iso(lit(bad).cast("string"))) is None, bad
    as_of = dates.as_timestamp(AS_OF)
    for words, want in [("3 days ago", timedelta(days=3)), ("30+ posted", timedelta(0)), ("2 HOURS", timedelta(hours=2))]:
        got = one(F.unix_micros(dates.parse_relative(lit(words), as_of)))
        assert got == int((AS_OF - want).timestamp() * 1_000_000)
    assert one(dates.parse_relative(lit("today"), as_of)) is None
    for pay, want in [("$60k - $80k", (60, 80, "USD")), ("€1,200,000", (1200000, None, "EUR")), ("none", (None, None, None)), ("99999999999 £", (None, None, "GBP"))]:
        assert tuple(one(numbers.salary_range(lit(pay)))) == want
    assert one(numbers.round_even(lit(2.5))) == 2.0 and one(numbers.round_even(lit(3.5))) == 4.0


def test_containment_join_is_that_of_brute_force(spark, make):
    """Keywords of any length, among them 30,000 that stand nowhere; nothing is joined by a loop."""
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choices("abé \n", k=rng.randint(0, 60))) for _ in range(60)] + [None, "", "AB" * 40]
    words = {"".join(rng.choices("abé ", k=rng.randint(1, 6))) for _ in range(300)} | {"a\nb", "😀x", ""}
    rows = [(w, f"l{len(w) % 3}", len(w)) for w in sorted(words)] + [(f"none{i}", "none", 9) for i in range(30_000)]
    keywords = spark.createDataFrame(rows, "keyword STRING, label STRING, priority INT")
    got = lookups.containment_join(make(*[{"description": t} for t in texts]), "description", keywords, ("ingest_seq",))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {(i, n, label) for i, t in enumerate(texts) for w, label, n in rows[: len(words)] if w and w in (t or "").lower()}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_containment_join_meets_whole_keywords_only(spark, make):
    """Keywords are no longer compared with every text that holds some part of them; long ones, ones across
    the border of two pieces and halves of a character come out right."""
    piece = lookups._PIECE
    texts = ["x" * (piece - 3) + "needle" + "y" * 50, "a haystack of more than twelve letters", "a haystack of", "😀ab", "no"]
    words = ["needle", "haystack of more than", "haystack of less than", "?ab", "😀a", "n", "xyz"]
    rows = [(w, w, 0) for w in words]
    posts = make(*[{"description": t} for t in texts])
    short = spark.createDataFrame([r for r in rows if len(r[0]) <= lookups.GRAM], "keyword STRING, label STRING, priority INT")
    got = lookups.containment_join(posts, "description", short, ("ingest_seq",))
    assert "contains" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    both = lookups.containment_join(posts, "description", spark.createDataFrame(rows, short.schema), ("ingest_seq",))
    for df, of in ((got, [w for w in words if len(w) <= lookups.GRAM]), (both, words)):
        assert sorted((r["ingest_seq"], r["label"]) for r in df.collect()) == sorted((i, w) for i, t in enumerate(texts) for w in of if w in t)


def test_containment_join_searches_a_text_once(spark, make, monkeypatch):
    """No stretch of a text becomes a row and only rows of a number that comes again are made distinct; keywords in several parts,
    shared labels, long keywords and null numbers come out right."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(2)
    texts = ["".join(rng.choices("abé ", k=rng.choice([0, 5, 40, 400]))) for _ in range(40)] + [None, "xABé"]
    words = sorted({"".join(rng.choices("abé ", k=rng.choice([1, 2, 3, 5, 9, 14, 17, 30]))) for _ in range(200)}
                   | {t[3:28].lower() for t in texts if t} | {t[1:18] for t in texts if t})
    posts = make(*[{"description": t} for t in texts])
    numbers = {"unique": F.col("ingest_seq"), "repeated": F.col("ingest_seq") % 7, "null": F.when(F.col("ingest_seq") % 3 > 0, F.col("ingest_seq"))}
    for owned in (lambda w: (w, 0), lambda w: (f"l{len(w)}", len(w) % 2), lambda w: (None, None)):
        rows = [(w, *owned(w)) for w in words] + [(words[5], "more", 5)]
        keywords = spark.createDataFrame(rows, "keyword STRING, label STRING, priority INT")
        for kind, number in numbers.items():
            sought = posts.withColumn("ingest_seq", number)
            place = {i: i if kind == "unique" else i % 7 if kind == "repeated" else i if i % 3 else None for i in range(len(texts))}
            want = {(place[i], n, label) for i, t in enumerate(texts) for w, label, n in rows if w and w in (t or "").lower()}
            for most in (1 << 20, 30) if kind == "null" else (1 << 20,):
                monkeypatch.setattr(lookups, "WORDS", most)
                got = lookups.containment_join(sought, "description", keywords, ("ingest_seq",))
                plan = got._jdf.queryExecution().optimizedPlan().toString()
                assert "Generate" not in plan
                if kind == "unique" and most > 30:
                    assert "Aggregate" not in plan and "Join" not in plan
                got = [tuple(r) for r in got.collect()]
                assert len(got) == len(set(got)) and set(got) == want, (kind, most)
