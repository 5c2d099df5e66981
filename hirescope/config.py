"""Settings that operators take as an argument; nothing is read from the environment."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from hirescope import fixed_values as fv


@dataclass(frozen=True)
class Config:
    """Keyword lists, limits and switches.

    ``as_of`` is the clock: no operator reads the current time by itself.
    The boolean switches turn known quirks of the original matching rules off.
    """

    as_of: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    role_keywords: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(fv.ROLE_KEYWORDS))
    enabled_roles: tuple[str, ...] = ("analytics", "business_development", "customer_service")
    irrelevant_words: tuple[str, ...] = fv.IRRELEVANT_TITLE_WORDS
    senior_words: tuple[str, ...] = fv.SENIOR_TITLE_WORDS
    entry_words: tuple[str, ...] = fv.ENTRY_TITLE_WORDS
    entry_levels: tuple[str, ...] = fv.ENTRY_LEVELS
    remote_words: tuple[str, ...] = fv.REMOTE_WORDS
    target_locations: tuple[str, ...] = fv.TARGET_LOCATIONS
    scam_phrases: tuple[str, ...] = fv.SCAM_PHRASES
    staffing_phrases: tuple[str, ...] = fv.STAFFING_PHRASES
    technical_skills: tuple[str, ...] = fv.TECHNICAL_SKILLS
    soft_skills: tuple[str, ...] = fv.SOFT_SKILLS
    business_skills: tuple[str, ...] = fv.BUSINESS_SKILLS
    skill_categories: dict[str, str] = field(default_factory=lambda: dict(fv.SKILL_CATEGORIES))
    source_caps: dict[str, int] = field(default_factory=dict)  # first N postings of a board's crawl
    max_age_days: int = 14
    summary_length: int = 500
    word_boundaries: bool = False        # title keywords must be whole words
    normalize_location_first: bool = False  # resolve country aliases before the location filter
    symbol_terms_match: bool = False     # let "c++" and "c#" end at a non-word character
    strict_required: bool = False        # a required term must be a whole word
    legacy_store_key: bool = False       # external_id alone identifies a stored posting

    @property
    def skills(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.technical_skills + self.soft_skills + self.business_skills))

    def category_of(self, skill: str) -> str:
        if skill in self.skill_categories:
            return self.skill_categories[skill]
        if skill in self.technical_skills:
            return "technical"
        return "business" if skill in self.business_skills else "soft"


@dataclass(frozen=True)
class Profile:
    """A candidate: what they know, how long they have worked, what they aim for."""

    skills: tuple[str, ...] = ("sql", "excel", "python")
    experience_years: int = 1
    target_role: str | None = None

    @property
    def skill_set(self) -> tuple[str, ...]:
        return tuple(sorted({s.lower() for s in self.skills}))
