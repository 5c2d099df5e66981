"""Boards that answer in JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirescope import fixed_values as fv
from hirescope.config import Config
from hirescope.functions.dates import parse_iso
from hirescope.functions.numbers import salary_range, whole_number
from hirescope.functions.text import (
    blank_if_null,
    contains_any,
    first_contained,
    lookup,
    strip,
    text_or,
    title_case,
)
from hirescope.schemas import posting_struct
from hirescope.sources.registry import Source, kept_if, one_record, register

WTTJ_SITE = "https://www.welcometothejungle.com"


def filled(c: Column) -> Column:
    return blank_if_null(c) != ""


def truthy(c: Column) -> Column:
    """Whether a JSON value, read as text, counts as true."""
    return filled(c) & ~F.lower(c).isin("false", "0", "0.0", "[]", "{}")


def nonzero(c: Column) -> Column:
    return F.nullif(whole_number(c), F.lit(0))


def level_from_title(title: Column, source: str) -> Column:
    senior = contains_any(F.lower(title), fv.LEVEL_WORDS[source])
    return F.when(senior, "Senior").otherwise("Entry-Level")


def graded_level_from_title(title: Column) -> Column:
    return F.coalesce(first_contained(F.lower(title), fv.REMOTEOK_LEVEL_WORDS), F.lit("Entry-Level"))


def country_from_location(location: Column) -> Column:
    """Country named in free text; first key of the table wins, anything unknown is Remote."""
    place = F.lower(blank_if_null(location))
    named = F.coalesce(*[F.when(place.contains(k), F.lit(v)) for k, v in fv.LOCATION_COUNTRIES.items()])
    return F.when((place == "") | place.contains("remote"), "Remote").otherwise(
        F.coalesce(named, F.lit("Remote"))
    )


def before_comma(c: Column) -> Column:
    return F.substring_index(blank_if_null(c), ",", 1)


def _remoteok(p: Column, context: Column, cfg: Config) -> Column:
    page = F.concat(F.lit("https://remoteok.com/remote-jobs/"), p["id"])
    low, high = p["salary_min"], p["salary_max"]
    readable = F.lit(True)
    for amount in (low, high):  # an unreadable salary voids the whole record
        readable = readable & (~filled(amount) | whole_number(amount).isNotNull())
    # As a variant the field tells an explicit null (no) from a missing one (yes).
    onsite = p["remote"].isNotNull() & ~truthy(F.try_variant_get(p["remote"], "$", "string"))
    return kept_if(
        p["id"].isNotNull() & filled(p["position"]) & filled(p["company"]) & readable,
        posting_struct(
            source=F.lit("remoteok"),
            external_id=p["id"],
            title=p["position"],
            company=p["company"],
            url=page,
            apply_url=text_or(p["url"], page),
            description=blank_if_null(p["description"]),
            country=country_from_location(p["location"]),
            city=blank_if_null(p["location"]),
            remote_type=F.when(onsite, "onsite").otherwise("remote"),
            salary_min=nonzero(low),
            salary_max=nonzero(high),
            experience_level=graded_level_from_title(p["position"]),
            posting_date=parse_iso(p["date"]),
        ),
    )


register(
    Source(
        "remoteok",
        one_record(
            "id STRING, position STRING, company STRING, date STRING, remote VARIANT, "
            "salary_min STRING, salary_max STRING, url STRING, description STRING, location STRING"
        ),
        _remoteok,
    )
)


def _remotive(p: Column, context: Column, cfg: Config) -> Column:
    place = blank_if_null(p["candidate_required_location"])
    anywhere = (place == "") | F.lower(place).contains("worldwide")
    pay = salary_range(blank_if_null(p["salary"]))
    return kept_if(
        filled(p["title"]) & filled(p["company_name"]),
        posting_struct(
            source=F.lit("remotive"),
            external_id=blank_if_null(p["id"]),
            title=p["title"],
            company=p["company_name"],
            url=blank_if_null(p["url"]),
            apply_url=blank_if_null(p["url"]),
            description=blank_if_null(p["description"]),
            country=F.when(anywhere, "Remote").otherwise(strip(place)),
            remote_type=F.lit("remote"),
            salary_min=pay["salary_min"],
            salary_max=pay["salary_max"],
            salary_currency=pay["salary_currency"],
            experience_level=level_from_title(p["title"], "remotive"),
            posting_date=parse_iso(p["publication_date"]),
        ),
    )


register(
    Source(
        "remotive",
        one_record(
            "id STRING, title STRING, company_name STRING, publication_date STRING, "
            "candidate_required_location STRING, salary STRING, url STRING, description STRING"
        ),
        _remotive,
    )
)


def _greenhouse(p: Column, board: Column, cfg: Config) -> Column:
    job_id = blank_if_null(p["id"])
    fallback = F.concat(F.lit("https://boards.greenhouse.io/"), board, F.lit("/jobs/"), job_id)
    url = F.coalesce(p["absolute_url"], fallback)
    return kept_if(
        filled(p["title"]),
        posting_struct(
            source=F.lit("greenhouse"),
            external_id=F.concat(board, F.lit("_"), job_id),
            title=p["title"],
            company=title_case(board),
            url=url,
            apply_url=url,
            country=blank_if_null(p["location"]["name"]),
            experience_level=level_from_title(p["title"], "greenhouse"),
            posting_date=parse_iso(text_or(p["updated_at"], p["created_at"])),
            raw_data=F.to_json(F.struct(board.alias("board"))),
        ),
    )


register(
    Source(
        "greenhouse",
        one_record(
            "id STRING, title STRING, absolute_url STRING, updated_at STRING, created_at STRING, "
            "location STRUCT<name: STRING>"
        ),
        _greenhouse,
    )
)


def _lever(p: Column, company: Column, cfg: Config) -> Column:
    url = blank_if_null(p["hostedUrl"])
    return kept_if(
        filled(p["text"]),
        posting_struct(
            source=F.lit("lever"),
            external_id=blank_if_null(p["id"]),
            title=p["text"],
            company=title_case(company),
            url=url,
            apply_url=text_or(p["applyUrl"], url),
            country=blank_if_null(p["categories"]["location"]),
            experience_level=level_from_title(p["text"], "lever"),
            posting_date=F.timestamp_millis(F.nullif(p["createdAt"], F.lit(0).cast("bigint"))),
            raw_data=F.to_json(p["categories"]),
        ),
    )


register(
    Source(
        "lever",
        one_record(
            "id STRING, text STRING, hostedUrl STRING, applyUrl STRING, createdAt BIGINT, "
            "categories STRUCT<team: STRING, department: STRING, location: STRING>"
        ),
        _lever,
    )
)


def _ashby(p: Column, company: Column, cfg: Config) -> Column:
    fallback = F.concat(F.lit("https://jobs.ashbyhq.com/"), company, F.lit("/"), blank_if_null(p["id"]))
    url = text_or(p["url"], fallback)
    return kept_if(
        filled(p["title"]),
        posting_struct(
            source=F.lit("ashby"),
            external_id=blank_if_null(p["id"]),
            title=p["title"],
            company=title_case(company),
            url=url,
            apply_url=url,
            country=blank_if_null(p["locationName"]),
            experience_level=level_from_title(p["title"], "ashby"),
            employment_type=text_or(F.lower(p["employmentType"]), "unknown"),
            posting_date=parse_iso(p["createdAt"]),
            raw_data=F.to_json(F.struct(p["departmentName"].alias("department"), p["teamName"].alias("team"))),
        ),
    )


register(
    Source(
        "ashby",
        one_record(
            "id STRING, title STRING, locationName STRING, employmentType STRING, "
            "departmentName STRING, teamName STRING, url STRING, createdAt STRING"
        ),
        _ashby,
    )
)

_SMARTRECRUITERS_ITEM = (
    "STRUCT<id: STRING, name: STRING, ref: STRING, releasedDate: STRING, applyUrl: STRING, "
    "location: STRUCT<city: STRING, country: STRING>>"
)


def _smartrecruiters_records(payload: Column) -> Column:
    bare_list = F.ltrim(payload).startswith("[")
    return F.when(bare_list, F.from_json(payload, f"ARRAY<{_SMARTRECRUITERS_ITEM}>")).otherwise(
        F.from_json(payload, f"content ARRAY<{_SMARTRECRUITERS_ITEM}>")["content"]
    )


def _smartrecruiters(p: Column, company: Column, cfg: Config) -> Column:
    ref = blank_if_null(p["ref"])
    url = F.concat(F.lit("https://careers.smartrecruiters.com/"), company, F.lit("/"), ref)
    return kept_if(
        filled(p["name"]),
        posting_struct(
            source=F.lit("smartrecruiters"),
            external_id=text_or(ref, blank_if_null(p["id"])),
            title=p["name"],
            company=title_case(company),
            url=url,
            apply_url=F.coalesce(p["applyUrl"], url),
            country=blank_if_null(p["location"]["country"]),
            city=blank_if_null(p["location"]["city"]),
            experience_level=level_from_title(p["name"], "smartrecruiters"),
            posting_date=parse_iso(p["releasedDate"]),
            raw_data=F.to_json(p),
        ),
    )


register(Source("smartrecruiters", _smartrecruiters_records, _smartrecruiters))


def _adzuna(p: Column, code: Column, cfg: Config) -> Column:
    return kept_if(
        filled(p["title"]),
        posting_struct(
            source=F.lit("adzuna"),
            external_id=blank_if_null(p["id"]),
            title=p["title"],
            company=blank_if_null(p["company"]["display_name"]),
            url=blank_if_null(p["redirect_url"]),
            apply_url=blank_if_null(p["redirect_url"]),
            description=blank_if_null(p["description"]),
            country=F.coalesce(lookup(code, fv.COUNTRY_CODES), code),
            city=before_comma(p["location"]["display_name"]),
            salary_min=nonzero(p["salary_min"]),
            salary_max=nonzero(p["salary_max"]),
            # Every country but one is labelled EUR, as in the original data.
            salary_currency=F.when(code == "gb", "GBP").otherwise("EUR"),
            experience_level=level_from_title(p["title"], "adzuna"),
            posting_date=parse_iso(p["created"]),
        ),
    )


register(
    Source(
        "adzuna",
        one_record(
            "id STRING, title STRING, redirect_url STRING, description STRING, created STRING, "
            "salary_min STRING, salary_max STRING, company STRUCT<display_name: STRING>, "
            "location STRUCT<display_name: STRING>"
        ),
        _adzuna,
    )
)


def _eu_startup(p: Column, context: Column, cfg: Config) -> Column:
    url = text_or(p["apply_url"], blank_if_null(p["url"]))
    is_object = F.ltrim(blank_if_null(p["company"])).startswith("{")
    company = F.when(is_object, F.get_json_object(p["company"], "$.name")).otherwise(p["company"])
    remote = truthy(p["remote"])
    place = blank_if_null(p["location"])
    return kept_if(
        filled(p["title"]),
        posting_struct(
            source=F.lit("eu_startup_jobs"),
            external_id=blank_if_null(p["id"]),
            title=p["title"],
            company=blank_if_null(company),
            url=url,
            apply_url=url,
            description=blank_if_null(p["description"]),
            country=F.when(remote, "Remote").otherwise(place),
            city=before_comma(place),
            remote_type=F.when(remote, "remote").otherwise("hybrid"),
            experience_level=level_from_title(p["title"], "eu_startup_jobs"),
            posting_date=parse_iso(text_or(p["created_at"], p["published_at"])),
        ),
    )


register(
    Source(
        "eu_startup_jobs",
        one_record(
            "id STRING, title STRING, company STRING, apply_url STRING, url STRING, description STRING, "
            "location STRING, remote STRING, created_at STRING, published_at STRING"
        ),
        _eu_startup,
    )
)


def _wttj(p: Column, context: Column, cfg: Config) -> Column:
    title = text_or(p["name"], p["title"])
    org = blank_if_null(p["organization"])
    is_object = F.ltrim(org).startswith("{")
    company = F.when(is_object, F.get_json_object(org, "$.name")).otherwise(org)
    org_slug = blank_if_null(F.when(is_object, F.get_json_object(org, "$.slug")))
    job_slug = blank_if_null(p["slug"])
    office = F.get(p["offices"], F.lit(0))
    url = F.when(
        (org_slug != "") & (job_slug != ""),
        F.concat(F.lit(f"{WTTJ_SITE}/en/companies/"), org_slug, F.lit("/jobs/"), job_slug),
    ).otherwise(f"{WTTJ_SITE}/en/jobs")
    known_modes = p["remote"].isin("full_remote", "partial", "no", "punctual")
    return kept_if(
        filled(title),
        posting_struct(
            source=F.lit("welcometothejungle"),
            external_id=text_or(p["objectID"], text_or(job_slug, url)),
            title=title,
            company=blank_if_null(company),
            url=url,
            apply_url=url,
            description=blank_if_null(p["summary"]),
            country=text_or(office["country"], blank_if_null(office["country_code"])),
            city=blank_if_null(office["city"]),
            remote_type=F.when(known_modes, p["remote"]).otherwise("unknown"),
            salary_min=whole_number(p["salary_minimum"]),
            salary_max=whole_number(p["salary_maximum"]),
            salary_currency=p["salary_currency"],
            employment_type=text_or(p["contract_type"], "unknown"),
            experience_level=F.when(p["experience_level_minimum"] >= 4, "Senior").otherwise("Entry-Level"),
            posting_date=parse_iso(p["published_at"]),
        ),
    )


register(
    Source(
        "welcometothejungle",
        one_record(
            "objectID STRING, name STRING, title STRING, slug STRING, organization STRING, "
            "offices ARRAY<STRUCT<country: STRING, country_code: STRING, city: STRING>>, "
            "published_at STRING, experience_level_minimum DOUBLE, remote STRING, summary STRING, "
            "salary_minimum STRING, salary_maximum STRING, salary_currency STRING, contract_type STRING"
        ),
        _wttj,
    )
)


def _workday(p: Column, company: Column, cfg: Config) -> Column:
    title = text_or(p["title"], p["name"])
    path = blank_if_null(p["externalPath"])
    return kept_if(
        filled(title),
        posting_struct(
            source=F.lit("workday"),
            external_id=text_or(path, blank_if_null(F.get(p["bulletFields"], F.lit(0)))),
            title=title,
            company=title_case(company),
            url=F.concat(F.lit("https://"), company, F.lit(".myworkdayjobs.com"), path),
            country=text_or(p["locationsText"], blank_if_null(p["location"])),
            experience_level=level_from_title(title, "workday"),
            posting_date=parse_iso(text_or(p["postedOn"], p["startDate"])),
        ),
    )


register(
    Source(
        "workday",
        one_record(
            "title STRING, name STRING, externalPath STRING, bulletFields ARRAY<STRING>, "
            "locationsText STRING, location STRING, postedOn STRING, startDate STRING"
        ),
        _workday,
    )
)
