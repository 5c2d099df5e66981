"""Skill extraction and everything counted from it.

The text is scanned once with one pattern for the whole taxonomy, however many
terms it holds. Consumers should read the ``job_skills`` bridge (extracted once)
instead of extracting again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirescope import fixed_values as fv
from hirescope.config import Config
from hirescope.functions.stats import top, top_per_group
from hirescope.functions.text import WORD, blank_if_null, lookup, merged_pattern

_WORD_CHAR = f"(?={WORD})"
_NO_WORD_CHAR = f"(?!{WORD})"


def posting_text() -> Column:
    return F.concat_ws(" ", blank_if_null(F.col("title")), blank_if_null(F.col("description")))


def fold(text: Column) -> Column:
    """Lower case, with the four letters that only match i, k and s when case is ignored."""
    odd = text.contains("ſ") | text.contains("K") | text.contains("ı") | text.contains("İ")
    return F.lower(F.when(odd, F.translate(text, "ſKıİ", "skii")).otherwise(text))


def _end_of(term: str, cfg: Config) -> str:
    """A term ends where a word ends. After a symbol ("c++") that means before a word character."""
    if term[-1].isalnum() or cfg.symbol_terms_match:
        return _NO_WORD_CHAR
    return _WORD_CHAR


def term_pattern(cfg: Config) -> str:
    """Pattern that captures, at every word start, the longest term beginning there.

    The capture sits in a look-ahead: terms may overlap and every start is seen.
    """
    return f"(?<!{WORD})(?=(" + merged_pattern({t: _end_of(t, cfg) for t in cfg.skills}) + "))"


def contained_terms(cfg: Config) -> list[tuple[str, str]]:
    """(longer, shorter) pairs where the longer term always begins with the shorter one as a word."""
    return [
        (longer, shorter)
        for longer in cfg.skills
        for shorter in cfg.skills
        if longer != shorter and longer.startswith(shorter) and not longer[len(shorter)].isalnum()
        and longer[len(shorter)] != "_" and shorter[-1].isalnum()
    ]


def _restated(mentions: str, longer: str, shorter: str) -> Column:
    """One entry of the shorter term for every mention of the longer one."""
    return F.transform(F.filter(mentions, lambda t: t == longer), lambda _: F.lit(shorter))


def _with_mentions(df: DataFrame, cfg: Config) -> DataFrame:
    """``_folded`` text and ``_mentions``: one array entry per occurrence of a term."""
    df = df.withColumn("_folded", fold(posting_text()))
    # The pattern carries its own end tests, so the captured text is the term itself.
    df = df.withColumn("_longest", F.regexp_extract_all("_folded", F.lit(term_pattern(cfg)), F.lit(1)))
    implied = [_restated("_longest", longer, shorter) for longer, shorter in contained_terms(cfg)]
    return df.withColumn("_mentions", F.concat(F.col("_longest"), *implied)).drop("_longest")


def category_column(skill: Column, cfg: Config) -> Column:
    """Category by override, else by the family the term belongs to; unknown terms are soft."""
    return F.coalesce(lookup(skill, {s: cfg.category_of(s) for s in cfg.skills}), F.lit("soft"))


def taxonomy(spark: SparkSession, cfg: Config) -> DataFrame:
    """The taxonomy as a dimension: one row per term."""
    rows = [
        (s, "technical" if s in cfg.technical_skills else "business" if s in cfg.business_skills else "soft",
         cfg.category_of(s))
        for s in cfg.skills
    ]
    return spark.createDataFrame(rows, "skill STRING, family STRING, category STRING")


def extract_skills(df: DataFrame, cfg: Config) -> DataFrame:
    """Adds ``skills``: array of (name, category, is_required, count), by count desc, name asc.

    A skill is required if, on one line, a marker word is followed by it. The
    text after the first marker of each line is collected once per posting.
    """
    markers = "|".join(fv.REQUIRED_MARKERS)
    heads = "".join(sorted({m[0] for m in fv.REQUIRED_MARKERS}))  # cheap test before the list
    after_marker = F.regexp_extract_all("_folded", F.lit(f"(?d)(?=[{heads}])(?:{markers})(.*)"), F.lit(1))
    counted = F.transform(
        F.array_distinct("_mentions"),
        lambda name: F.struct(
            (-F.size(F.filter("_mentions", lambda m: m == name))).alias("minus"), name.alias("name")
        ),
    )

    def is_required(name: Column) -> Column:
        # Two references to the column: with one, Spark would inline its regular
        # expression into this function and run it once per skill.
        some = F.col("_after_marker") != ""
        if not cfg.strict_required:
            return some & F.contains(F.col("_after_marker"), name)
        escaped = F.regexp_replace(name, r"([^\w\s])", r"\\$1")
        whole = F.concat(F.lit(f"(?<!{WORD})"), escaped, F.lit(_NO_WORD_CHAR))
        return some & F.regexp_like(F.col("_after_marker"), whole)

    hits = F.transform(
        F.array_sort("_counted"),
        lambda hit: F.struct(
            hit["name"].alias("name"),
            category_column(hit["name"], cfg).alias("category"),
            is_required(hit["name"]).alias("is_required"),
            (-hit["minus"]).alias("count"),
        ),
    )
    return (
        _with_mentions(df, cfg)
        .withColumns({"_after_marker": F.array_join(after_marker, "\n"), "_counted": counted})
        .withColumn("skills", hits)
        .drop("_folded", "_mentions", "_after_marker", "_counted")
    )


def extract_skill_names(df: DataFrame, cfg: Config) -> DataFrame:
    """Adds ``skill_names``, the distinct terms of a posting, sorted. Skips the required check."""
    return (
        _with_mentions(df, cfg)
        .withColumn("skill_names", F.array_sort(F.array_distinct("_mentions")))
        .drop("_folded", "_mentions")
    )


def explode_names(df: DataFrame, *keep: str) -> DataFrame:
    """One row per (posting, skill).

    The outer form keeps Spark from adding a "not empty" filter below, which
    would scan the text a second time.
    """
    return df.select(*keep, F.explode_outer("skill_names").alias("skill")).where(F.col("skill").isNotNull())


def explode_hits(df: DataFrame, *keep: str) -> DataFrame:
    return (
        df.select(*keep, F.explode_outer("skills").alias("hit"))
        .where(F.col("hit").isNotNull())
        .select(*keep, F.col("hit.name").alias("skill"), "hit.category", "hit.is_required", "hit.count")
    )


def job_skills_bridge(df: DataFrame, cfg: Config) -> DataFrame:
    """Unique (fingerprint, skill) rows; of several postings with one fingerprint the first counts."""
    hits = explode_hits(extract_skills(df, cfg), "fingerprint", "ingest_seq")
    # Count and flag travel as one number: a minimum over a struct would sort every row first.
    low = F.col("count").cast("bigint") * 2 + F.col("is_required").cast("bigint")
    first = hits.groupBy("fingerprint", "skill").agg(F.min_by(low, "ingest_seq").alias("_first"))
    return first.select(
        "fingerprint", "skill",
        category_column(F.col("skill"), cfg).alias("category"),
        (F.col("_first") % 2 == 1).alias("is_required"),
        F.floor(F.col("_first") / 2).cast("int").alias("count"),
    )


def skill_dimension(bridge: DataFrame) -> DataFrame:
    """Skills with the number of postings that mention them."""
    return bridge.groupBy("skill", "category").agg(F.count(F.lit(1)).alias("frequency"))


def skill_demand(names: DataFrame) -> DataFrame:
    """Postings per skill from exploded rows; at most one row per term leaves a task."""
    return names.groupBy("skill").agg(F.count(F.lit(1)).alias("n"))


def skill_frequency(names: DataFrame, k: int = 50) -> DataFrame:
    return top(skill_demand(names), k, "n", "skill")


def skills_by(names: DataFrame, group: str, k: int) -> DataFrame:
    """Top k skills per group value; ``names`` has the group column and ``skill``."""
    counts = (
        names.withColumn(group, F.coalesce(F.col(group), F.lit("Unknown")))
        .groupBy(group, "skill")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_per_group(counts, [group], k, [F.desc("n"), F.asc("skill")])


def skills_by_country(names: DataFrame, k: int = 20) -> DataFrame:
    return skills_by(names, "country", k)


def skills_by_industry(names: DataFrame, companies: DataFrame, k: int = 15) -> DataFrame:
    """Top k skills per industry of the hiring company.

    Counts per (company, skill) are formed before the join, so a company with
    very many postings reaches it as at most one row per term.
    """
    per_company = names.groupBy("company_id", "skill").agg(F.count(F.lit(1)).alias("_n"))
    counts = (
        per_company.join(companies.select("company_id", "industry"), "company_id", "left")
        .withColumn("industry", F.coalesce("industry", F.lit("Unknown")))
        .groupBy("industry", "skill")
        .agg(F.sum("_n").alias("n"))
    )
    return top_per_group(counts, ["industry"], k, [F.desc("n"), F.asc("skill")])


def emerging_skills(names: DataFrame, postings: DataFrame, threshold: float = 0.1, k: int = 50) -> DataFrame:
    """Skills among the top k that at least ``threshold`` of all postings mention."""
    total = postings.agg(F.count(F.lit(1))).scalar()
    share = F.col("n") / F.greatest(F.col("total"), F.lit(1))
    return (
        skill_frequency(names, k)
        .withColumn("total", total)
        .withColumn("share", share)
        .where(F.col("share") >= threshold)
        .select("skill", "n", "share")
    )


def skill_totals(titles: DataFrame, cfg: Config, k: int = 20) -> DataFrame:
    """Occurrences (not postings) per skill over the titles alone."""
    only_titles = titles.select("title", F.lit("").alias("description"))
    mentions = (
        _with_mentions(only_titles, cfg)
        .select(F.explode_outer("_mentions").alias("skill"))
        .where(F.col("skill").isNotNull())
    )
    counts = mentions.groupBy("skill").agg(F.count(F.lit(1)).alias("n"))
    return top(counts, k, "n", "skill").withColumn("category", category_column(F.col("skill"), cfg))
