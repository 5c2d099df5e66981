"""SQL for DuckDB that states each registered query a second time.

The statements share the input rules with the queries and nothing else: terms
are counted one by one with their own pattern, dedup is walked row by row in a
recursive query, ranks come from window functions over full joins.
"""

from __future__ import annotations

from hirescope import fixed_values as fv
from workloads import inputs as I

RAW = "raw AS (SELECT " + ", ".join(f"{I.duck_rule(r)} AS {c}" for c, r in I.POSTING_RULES.items()) + " FROM documents)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"


def count_of(column: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, {lit(w)}) AS INT)" for w in words) + ")"


def case_of(column: str, table: dict, default: str, test="{c} = {k}") -> str:
    whens = " ".join(f"WHEN {test.format(c=column, k=lit(k))} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {whens} ELSE {default} END"


def query(*parts: str) -> str:
    """CTEs and a final select."""
    *ctes, final = parts
    recursive = "RECURSIVE " if any("UNION ALL SELECT" in c for c in ctes) else ""
    return f"WITH {recursive}" + ",\n".join(ctes) + "\n" + final


SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


LT = "lower(coalesce(title, ''))"
IRRELEVANT = any_of(LT, fv.IRRELEVANT_TITLE_WORDS)
SENIOR = any_of(LT, fv.SENIOR_TITLE_WORDS)
ROLE = "CASE " + " ".join(f"WHEN {any_of(LT, w)} THEN '{r}'" for r, w in fv.ROLE_KEYWORDS.items()) + " END"
ENTRY = (
    "(coalesce(lower(experience_level), '') IN (" + ", ".join(lit(x) for x in fv.ENTRY_LEVELS) + ") OR "
    + any_of(LT, fv.ENTRY_TITLE_WORDS) + ")"
)
REACH = any_of("lower(coalesce(country, ''))", list(fv.REMOTE_WORDS) + [t.lower() for t in fv.TARGET_LOCATIONS])

JUNIOR = (
    f"junior AS (SELECT * REPLACE ({ROLE} AS role_category) FROM raw WHERE NOT {IRRELEVANT} AND NOT {SENIOR} "
    f"AND {ROLE} IS NOT NULL AND {ENTRY})"
)


def greedy(source: str, name: str = "uniq") -> list[str]:
    """Rows kept by walking in arrival order with the list of keys seen on kept rows."""
    return [
        f"{name}_n AS (SELECT ingest_seq, lower({strip('title')}) || ':' || lower({strip('company')}) AS k, "
        f"md5(source || ':' || external_id) AS f, row_number() OVER (ORDER BY ingest_seq) AS i FROM {source})",
        f"{name}_walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS BIGINT) AS kept "
        f"UNION ALL SELECT n.i, CASE WHEN list_contains(w.seen, n.k) OR list_contains(w.seen, n.f) THEN w.seen "
        f"ELSE list_concat(w.seen, [n.k, n.f]) END, "
        f"CASE WHEN list_contains(w.seen, n.k) OR list_contains(w.seen, n.f) THEN NULL ELSE n.ingest_seq END "
        f"FROM {name}_walk w JOIN {name}_n n ON n.i = w.i + 1)",
        f"{name} AS (SELECT * FROM {source} WHERE ingest_seq IN (SELECT kept FROM {name}_walk WHERE kept IS NOT NULL))",
    ]


# --- parsing -----------------------------------------------------------------------

_suffix = r"(?i)\s*[-–—]\s*(Remote|Hybrid|Onsite|Full.?time|Part.?time).*"
CLEAN_TITLE = strip(
    f"regexp_replace(regexp_replace({strip('title')}, '{_suffix}', '', 'g'), '\\s*\\(.*?\\)\\s*$', '', 'g')"
)


def normalized(c: str) -> str:
    c = strip(f"lower({c})")
    for word in fv.TITLE_PREFIXES:
        c = f"replace({c}, '{word}', '')"
    return strip(c)


CLEAN_COMPANY = f"regexp_replace({strip('company')}, ',?\\s*Inc\\.?$|,\\s*LLC\\.?$|,\\s*Ltd\\.?$', '')"
COUNTRY = (
    f"CASE WHEN coalesce(country, '') = '' THEN 'Remote' ELSE "
    + case_of(f"lower({strip('country')})", fv.COUNTRY_ALIASES, strip("country")) + " END"
)


def ordered(column: str, choices) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(column, w)} THEN '{label}'" for label, w in choices)


LEVEL = ordered("lower(coalesce(experience_level, ''))", (
    ("Entry-Level", ("entry", "junior", "graduate", "intern")),
    ("Mid-Level", ("mid", "intermediate")), ("Senior", ("senior", "sr", "lead")))) + " ELSE 'Entry-Level' END"
EMPLOYMENT = ordered("lower(employment_type)", (
    ("full_time", ("full",)), ("part_time", ("part",)), ("contract", ("contract",)),
    ("internship", ("intern",)), ("graduate", ("graduate",)))) + " ELSE 'unknown' END"
_flat = strip(f"regexp_replace(regexp_replace(coalesce(description, ''), '<[^>]+>', ' ', 'g'), '{SPACE}+', ' ', 'g')")
SUMMARY = f"CASE WHEN length({_flat}) <= 500 THEN {_flat} ELSE substr({_flat}, 1, 500) || '...' END"
APPLY = "CASE WHEN coalesce(apply_url, '') = '' THEN url ELSE apply_url END"


def parsed(source: str, name: str = "parsed", summary: bool = False) -> str:
    extra = f", {SUMMARY} AS description_summary" if summary else ""
    return (
        f"{name} AS (SELECT * EXCLUDE (t), {normalized('title')} AS normalized_title FROM ("
        f"SELECT * REPLACE ({CLEAN_TITLE} AS title, {CLEAN_COMPANY} AS company, {COUNTRY} AS country, {LEVEL} AS experience_level, "
        f"{EMPLOYMENT} AS employment_type, {APPLY} AS apply_url, coalesce(description, '') AS description, coalesce(city, '') AS city), "
        f"1 AS t, md5(source || ':' || external_id) AS fingerprint{extra} FROM {source} WHERE employment_type IS NOT NULL))"
    )


# --- validation ----------------------------------------------------------------------

SCAM = f"least({count_of('lower(coalesce(title, ' + chr(39)*2 + ') || ' + lit(' ') + ' || coalesce(description, ' + chr(39)*2 + '))', fv.SCAM_PHRASES)} * CAST(0.3 AS DOUBLE), CAST(1.0 AS DOUBLE))"
URL = (
    "CAST(CASE WHEN coalesce(url, '') = '' THEN 0.0 WHEN NOT (starts_with(url, 'http://') OR starts_with(url, 'https://')) THEN 0.1 "
    "WHEN length(url) < 10 THEN 0.2 ELSE 1.0 END AS DOUBLE)"
)
FRESH = (
    f"CAST(CASE WHEN posting_date IS NULL THEN 0.5 WHEN floor(({I.AS_OF_MICROS} - epoch_us(posting_date)) / 86400000000.0) <= 14 THEN 1.0 "
    f"WHEN floor(({I.AS_OF_MICROS} - epoch_us(posting_date)) / 86400000000.0) <= 28 THEN 0.5 ELSE 0.1 END AS DOUBLE)"
)


def _has(*columns: str) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN coalesce(CAST({c} AS VARCHAR), '') <> '' THEN 1 ELSE 0 END" for c in columns) + f" AS DOUBLE) / {len(columns)}"


COMPLETE = (
    f"{_has('title', 'company', 'url')} * CAST(0.7 AS DOUBLE) + "
    f"{_has('country', 'description', 'posting_date', 'experience_level')} * CAST(0.3 AS DOUBLE)"
)
STAFFING = any_of("lower(coalesce(company, '') || ' ' || coalesce(description, ''))", fv.STAFFING_PHRASES)


def validated(source: str, name: str = "checked") -> list[str]:
    return [
        f"{name}_s AS (SELECT *, {SCAM} AS scam, {URL} AS us, {FRESH} AS fs, {COMPLETE} AS cs, {STAFFING} AS st FROM {source})",
        f"{name} AS (SELECT * EXCLUDE (scam, us, fs, cs, st), "
        "greatest(0.0, least(1.0, CAST(1.0 AS DOUBLE) + CASE WHEN scam > 0.5 THEN -scam ELSE 0.0 END + CASE WHEN us < 0.3 THEN us - CAST(0.3 AS DOUBLE) ELSE 0.0 END "
        "+ CASE WHEN fs < 0.3 THEN fs - CAST(0.3 AS DOUBLE) ELSE 0.0 END + CASE WHEN cs < 0.5 THEN cs - CAST(0.5 AS DOUBLE) ELSE 0.0 END "
        "+ CASE WHEN st THEN CAST(-0.3 AS DOUBLE) ELSE 0.0 END)) AS score, "
        "list_filter([CASE WHEN scam > 0.5 THEN 'scam_indicators' END, CASE WHEN us < 0.3 THEN 'invalid_url' END, "
        "CASE WHEN fs < 0.3 THEN 'too_old' END, CASE WHEN cs < 0.5 THEN 'incomplete_data' END, "
        f"CASE WHEN st THEN 'staffing_agency' END], lambda r: r IS NOT NULL) AS reasons FROM {name}_s)",
    ]


# --- skills -----------------------------------------------------------------------------

ALL_SKILLS = tuple(dict.fromkeys(fv.TECHNICAL_SKILLS + fv.SOFT_SKILLS + fv.BUSINESS_SKILLS))
_NW = r"[^\p{L}\p{N}_]"
_MARK = chr(1)


def _marked(term: str) -> str:
    """A term as it reads in a text where both sides of every separator carry a mark."""
    return _MARK + "".join(c if c.isalnum() or c == "_" else _MARK + c + _MARK for c in term)


def _needle(term: str) -> str:
    return _marked(term) + (_MARK if term[-1].isalnum() else "")


def _category(skill: str) -> str:
    if skill in fv.SKILL_CATEGORIES:
        return fv.SKILL_CATEGORIES[skill]
    return "technical" if skill in fv.TECHNICAL_SKILLS else "business" if skill in fv.BUSINESS_SKILLS else "soft"


# needle: what to count; not_after: occurrences to take off again (a term that ends
# in a symbol only counts when a word character follows).
TERMS = "terms(skill, category, needle, not_after) AS (VALUES " + ", ".join(
    f"({lit(s)}, {lit(_category(s))}, replace({lit(_needle(s).replace(_MARK, '~'))}, '~', chr(1)), "
    + ("NULL" if s[-1].isalnum() else f"replace({lit((_needle(s) + _MARK).replace(_MARK, '~'))}, '~', chr(1))") + ")"
    for s in ALL_SKILLS
) + ")"


def _occurrences(text: str, needle: str) -> str:
    return f"(length({text}) - length(replace({text}, {needle}, ''))) // length({needle})"


def skills(source: str, name: str = "hits", text: str = "title || ' ' || coalesce(description, '')") -> list[str]:
    """One row per (posting, skill): every term is searched in every text and counted on its own."""
    required = " OR ".join(
        f"(strpos(ln, {lit(m)}) > 0 AND contains(substr(ln, strpos(ln, {lit(m)}) + {len(m)}), c.skill))"
        for m in fv.REQUIRED_MARKERS
    )
    return [
        TERMS,
        f"{name}_t AS (SELECT *, lower({text}) AS low, chr(1) || regexp_replace(lower({text}), '({_NW})', chr(1) || '\\1' || chr(1), 'g') || chr(1) AS wide FROM {source})",
        f"{name}_c AS (SELECT p.*, t.skill, t.category, t.needle, t.not_after FROM {name}_t p JOIN terms t ON contains(p.wide, t.needle))",
        f"{name}_n AS (SELECT c.*, {_occurrences('wide', 'needle')} - coalesce({_occurrences('wide', 'not_after')}, 0) AS n_hits FROM {name}_c c)",
        f"{name} AS (SELECT c.* EXCLUDE (wide, needle, not_after, low), "
        f"len(list_filter(string_split(low, chr(10)), lambda ln: {required})) > 0 AS is_required FROM {name}_n c WHERE n_hits > 0)",
    ]


PROFILE_SKILLS = ", ".join(lit(s) for s in I.PROFILE.skill_set)


def top(select: str, n: str, key: str, k: int) -> str:
    return f"{select} ORDER BY {n} DESC, {key} ASC LIMIT {k}"
