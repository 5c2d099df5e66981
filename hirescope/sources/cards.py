"""Boards that answer with HTML result cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirescope.config import Config
from hirescope.functions.dates import as_timestamp, parse_iso, parse_relative
from hirescope.functions.text import blank_if_null, element_text, strip, text_or, unescape
from hirescope.schemas import posting_struct
from hirescope.sources.json_boards import before_comma, filled, level_from_title
from hirescope.sources.registry import Source, kept_if, register

INDEED_SITE = "https://www.indeed.com"


def tag(name: str, css_class: str) -> str:
    """Regex of an opening tag that carries a class."""
    return rf'<{name}\b[^>]*class=["\'][^"\'>]*(?<![\w-]){css_class}(?![\w-])[^>]*>'


def extract(html: Column, pattern: str, group: int = 1) -> Column:
    """First match or null (Spark's own function gives an empty string for no match)."""
    return F.when(html.rlike("(?is)" + pattern), F.regexp_extract(html, "(?is)" + pattern, group))


def attribute(opening_tag: Column, name: str) -> Column:
    value = F.regexp_extract(opening_tag, rf'(?is)\b{name}\s*=\s*["\']([^"\'>]*)["\']', 1)
    return unescape(value)


def _list_items(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))


def _linkedin(card: Column, location: Column, cfg: Config) -> Column:
    title = element_text(extract(card, tag("h3", "base-search-card__title") + r"(.*?)</h3>"))
    company = element_text(extract(card, tag("h4", "base-search-card__subtitle") + r"(.*?)</h4>"))
    link = extract(card, tag("a", "base-card__full-link"), 0)
    url = F.substring_index(strip(attribute(link, "href")), "?", 1)
    moment = attribute(extract(card, r"<time\b[^>]*>", 0), "datetime")
    city = element_text(extract(card, tag("span", "job-search-card__location") + r"(.*?)</span>"))
    last_segment = F.substring_index(F.rtrim(url, F.lit("/")), "/", -1)
    return kept_if(
        filled(title) & filled(company) & filled(url),
        posting_struct(
            source=F.lit("linkedin"),
            external_id=text_or(F.substring_index(last_segment, "-", -1), url),
            title=title,
            company=company,
            url=url,
            apply_url=url,
            country=location,
            city=blank_if_null(city),
            experience_level=level_from_title(title, "linkedin"),
            posting_date=parse_iso(moment),
            raw_data=F.to_json(F.struct(location.alias("location_query"))),
        ),
    )


register(Source("linkedin", _list_items, _linkedin))


def _cut(html: Column, *classes: str) -> Column:
    """Pieces of a page that begin with a block of one of the classes."""
    opening = "|".join(tag("div", c) for c in classes)
    return F.filter(F.split(html, f"(?is)(?=(?:{opening}))"), lambda c: c.rlike(f"(?is)^(?:{opening})"))


def _result_cards(html: Column) -> Column:
    """Cards are nested blocks, so the page is cut where each one opens. Blocks of class "result"
    are cards only inside the result list."""
    parts = F.split(html, "(?is)(?=" + tag("div", "jobsearch-ResultsList") + ")", 2)
    inside = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    return F.concat(_cut(F.get(parts, F.lit(0)), "job_seen_beacon"), _cut(inside, "job_seen_beacon", "result"))


def _indeed(card: Column, context: Column, cfg: Config) -> Column:
    in_heading = tag("h2", "jobTitle") + r"(?:(?!</h2>).)*?(<a\b[^>]*>)(.*?)</a>"
    direct = "(" + tag("a", "jcs-JobTitle") + r")(.*?)</a>"
    link = F.coalesce(extract(card, in_heading, 1), extract(card, direct, 1))
    title = element_text(F.coalesce(extract(card, in_heading, 2), extract(card, direct, 2)))
    company = F.coalesce(
        extract(card, r'<span\b[^>]*data-testid=["\']company-name["\'][^>]*>(.*?)</span>'),
        extract(card, tag("span", "companyName") + r"(.*?)</span>"),
    )
    place = F.coalesce(
        extract(card, r'<div\b[^>]*data-testid=["\']text-location["\'][^>]*>(.*?)</div>'),
        extract(card, tag("div", "companyLocation") + r"(.*?)</div>"),
    )
    age = element_text(extract(card, tag("span", "date") + r"(.*?)</span>"))
    href = attribute(link, "href")
    url = F.when(filled(href) & ~href.startswith("http"), F.concat(F.lit(INDEED_SITE), href)).otherwise(href)
    own_id = F.replace(attribute(link, "id"), F.lit("job_"), F.lit(""))
    country = F.substring_index(context, "|", -1)
    return kept_if(
        link.isNotNull(),
        posting_struct(
            source=F.lit("indeed"),
            external_id=text_or(attribute(link, "data-jk"), text_or(own_id, F.substring(title, 1, 100))),
            title=title,
            company=F.coalesce(element_text(company), F.lit("Unknown")),
            url=url,
            apply_url=url,
            country=country,
            city=before_comma(element_text(place)),
            experience_level=level_from_title(title, "indeed"),
            posting_date=parse_relative(age, as_timestamp(cfg.as_of)),
            raw_data=F.to_json(F.struct(F.substring_index(context, "|", 1).alias("country_code"))),
        ),
    )


# Context of this board: "country code|country name".
register(Source("indeed", _result_cards, _indeed))
