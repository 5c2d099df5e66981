"""Matching candidates to postings and to portfolio projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hirescope import fixed_values as fv
from hirescope.catalog import catalog_categories
from hirescope.config import Profile
from hirescope.functions.numbers import round_even
from hirescope.functions.stats import top_per_group
from hirescope.functions.text import blank_if_null, contains_any, lookup
from hirescope.session import materialize


def string_array(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def base_score(overlap: Column, posting_skills: Column) -> Column:
    """Share of the posting's skills the candidate has; 0.5 for a posting without skills."""
    return F.when(posting_skills == 0, 0.5).otherwise(overlap / F.greatest(posting_skills, F.lit(1)))


def is_entry_posting(level: Column) -> Column:
    return contains_any(F.lower(blank_if_null(level)), ("entry", "junior", "graduate"))


def boosted(base: Column, entry_posting: Column, junior: Column, visa: Column) -> Column:
    """+0.1 for a junior posting and a junior candidate, then +0.05 for visa, each capped at 1."""
    score = F.when(entry_posting & junior, F.least(base + 0.1, F.lit(1.0))).otherwise(base)
    return F.when(visa, F.least(score + 0.05, F.lit(1.0))).otherwise(score)


def overlap_columns(df: DataFrame, profile: Profile) -> DataFrame:
    """``strengths`` and ``missing_skills`` of a profile, both sorted."""
    mine = string_array(profile.skill_set)
    return df.withColumns(
        {
            "strengths": F.array_sort(F.array_intersect("skill_names", mine)),
            "missing_skills": F.array_sort(F.array_except("skill_names", mine)),
        }
    )


def match_base(df: DataFrame, profile: Profile) -> DataFrame:
    with_overlap = overlap_columns(df, profile)
    return with_overlap.withColumn("base_score", base_score(F.size("strengths"), F.size("skill_names")))


def match_boost(df: DataFrame, profile: Profile) -> DataFrame:
    return match_base(df, profile).withColumn(
        "raw_score",
        boosted(
            F.col("base_score"),
            is_entry_posting(F.col("experience_level")),
            F.lit(profile.experience_years <= 3),
            F.coalesce("visa_sponsorship", F.lit(False)),
        ),
    )


def match_outcome(df: DataFrame, profile: Profile) -> DataFrame:
    """Score, readiness and success probability in percent with one decimal."""
    score = F.col("raw_score")
    success = score * 0.7 + F.when(F.coalesce("visa_sponsorship", F.lit(False)), 0.3).otherwise(0.0)
    return match_boost(df, profile).withColumns(
        {
            "match_score": round_even(score * 100, 1),
            "interview_readiness": round_even(F.least(score * 100 + 20, F.lit(100.0)), 1),
            "application_success_prob": round_even(F.least(success * 100, F.lit(100.0)), 1),
        }
    )


def match_advice(df: DataFrame) -> DataFrame:
    """Resume and learning advice from the first five missing skills."""
    first_five = F.slice("missing_skills", 1, 5)
    add_skills = F.concat(F.lit(fv.ADVICE_ADD_SKILLS), F.array_join(first_five, ", "))
    lines = F.array(
        F.when(F.size("missing_skills") > 0, add_skills),
        F.when(~F.coalesce("visa_sponsorship", F.lit(False)), F.lit(fv.ADVICE_NO_VISA)),
        F.lit(fv.ADVICE_ALWAYS),
    )
    hints = F.transform(first_five, lambda s: F.concat(s, F.lit(": "), lookup(s, fv.LEARNING_HINTS)))
    return df.withColumns(
        {"resume_improvements": F.array_compact(lines), "learning_recs": F.array_compact(hints)}
    )


def match_jobs(df: DataFrame, profile: Profile) -> DataFrame:
    """One profile against every posting: a projection, since the profile is a constant."""
    return match_advice(match_outcome(df, profile)).drop("base_score", "raw_score")


def rank_matches(matches: DataFrame, k: int = 10) -> DataFrame:
    """Best k matches; equal scores in order of arrival."""
    order = [F.desc("match_score"), F.asc("ingest_seq")]
    best = matches.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order)))


def rec_categories(postings: DataFrame, profile: Profile, explicit: str | None = None) -> DataFrame:
    """Role categories to recommend projects for, with ``category_rank``.

    The explicit one, else the profile's target, else those of the postings by
    frequency, else analytics.
    """
    spark = postings.sparkSession
    known = catalog_categories()
    for chosen in (explicit, profile.target_role):
        if chosen in known:
            return spark.createDataFrame([(chosen, 1)], "role_category STRING, category_rank INT")
    counts = (
        postings.where(F.col("role_category").isin(*known))
        .groupBy("role_category")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # The fallback joins in with a count of 0: it leads only if nothing else is there.
    fallback = spark.createDataFrame([("analytics", 0)], "role_category STRING, n BIGINT")
    totals = counts.unionByName(fallback).groupBy("role_category").agg(F.sum("n").alias("n"))
    order = Window.partitionBy().orderBy(F.desc("n"), F.asc("role_category"))
    ranked = totals.withColumn("category_rank", F.row_number().over(order))
    return ranked.where((F.col("n") > 0) | (F.col("category_rank") == 1)).select("role_category", "category_rank")


def project_demand(projects: DataFrame, demand: DataFrame) -> DataFrame:
    """Sum of market demand over each project's skills; a skill nobody asks for counts 0."""
    key = ["role_category", "catalog_order"]
    wanted = projects.select(*key, F.explode(F.array_distinct(F.transform("skills", F.lower))).alias("skill"))
    scores = (
        wanted.join(demand, "skill", "left")
        .groupBy(*key)
        .agg(F.sum(F.coalesce("n", F.lit(0))).alias("market_demand_score"))
    )
    return projects.join(scores, key, "left").withColumn(
        "market_demand_score", F.coalesce("market_demand_score", F.lit(0).cast("bigint"))
    )


def project_annotate(projects: DataFrame, demand: DataFrame, profile: Profile) -> DataFrame:
    mine = string_array(profile.skill_set)
    skills = F.array_distinct(F.transform("skills", F.lower))
    return project_demand(projects, demand).withColumns(
        {
            "skills_you_have": F.array_sort(F.array_intersect(skills, mine)),
            "skills_youll_build": F.array_sort(F.array_except(skills, mine)),
        }
    )


def recommend_projects(
    projects: DataFrame, postings: DataFrame, demand: DataFrame, profile: Profile, explicit: str | None = None
) -> DataFrame:
    """Projects of the chosen categories, most wanted first; ``rank`` 1 to 8 is what a report shows."""
    # A handful of rows that two joins below read.
    categories = materialize(rec_categories(postings, profile, explicit), "rec-categories")
    annotated = project_annotate(projects.join(categories, "role_category"), demand, profile)
    order = Window.partitionBy().orderBy(
        F.desc("market_demand_score"), F.asc("category_rank"), F.asc("catalog_order")
    )
    return annotated.withColumn("rank", F.row_number().over(order))


# --- many users --------------------------------------------------------------------------

# Most percent that boosts alone can give.
_MAX_BOOST = 15.0
# Groups of a block that meet the classes in one task.
_BLOCK_ROWS = 10_000
# Postings of a kind that are looked at first when a user runs out of postings with a shared skill.
_HEAD = 1_000


def _user_classes(users: DataFrame) -> DataFrame:
    """``users`` with a class: same skills and same side of the 3-year line, same matches."""
    known = F.array_sort(F.array_distinct(F.transform("skills", F.lower)))
    return (
        users.withColumn("_known", known)
        .withColumn("_junior", F.coalesce(F.col("experience_years"), F.lit(0)) <= 3)
        .withColumn("class_id", F.md5(F.concat_ws("|", F.col("_junior").cast("string"), F.array_join("_known", "|"))))
    )


def _representatives(postings: DataFrame, k: int) -> DataFrame:
    """First k postings of every (skills, junior, visa) group; later ones of a group can never be
    in a top k. The bound on the rank lets every task drop all but k rows of a group before the
    shuffle, however large the group is."""
    described = postings.select(
        "ingest_seq",
        F.array_sort(F.array_distinct("skill_names")).alias("skill_names"),
        is_entry_posting(F.col("experience_level")).alias("entry"),
        F.coalesce("visa_sponsorship", F.lit(False)).alias("visa"),
    ).withColumn("group_id", F.md5(F.concat_ws("|", F.col("entry").cast("string"), F.col("visa").cast("string"), F.array_join("skill_names", "|"))))
    first = Window.partitionBy("group_id").orderBy("ingest_seq")
    return described.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r")


def _by_rarity(groups: DataFrame) -> DataFrame:
    """Adds ``by_rarity``: a group's skills, those that the fewest groups ask for first."""
    asked = groups.select("group_id", F.explode("skill_names").alias("skill"))
    rarity = asked.groupBy("skill").agg(F.count(F.lit(1)).alias("n_groups"))
    ordered = (
        asked.join(rarity, "skill")
        .groupBy("group_id")
        .agg(F.array_sort(F.collect_list(F.struct("n_groups", "skill"))).alias("_o"))
        .select("group_id", F.transform("_o", lambda o: o["skill"]).alias("by_rarity"))
    )
    return groups.join(ordered, "group_id", "left").withColumn(
        "by_rarity", F.coalesce("by_rarity", F.array().cast("array<string>"))
    )


def _percent(base: Column, entry: Column, junior: Column, visa: Column) -> Column:
    return round_even(boosted(base, entry, junior, visa) * 100, 1)


def _best(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("class_id").orderBy(F.desc("match_score"), F.asc("ingest_seq"))
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_BLOCK = ("skill", "n", "late", "entry", "visa")


def _entries(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists of a skill in blocks of equal impact, and the blocks.

    An entry is a group at one of its skills. Its block holds entries of that skill with as many skills in
    all, the same boosts and the same half of the order by rarity. There are as many blocks as the taxonomy
    allows, however many postings there are.
    """
    listed = groups.select(
        "group_id", "entry", "visa", "by_rarity", "seqs", F.size("by_rarity").alias("n"), F.posexplode("by_rarity").alias("at", "skill")
    ).withColumn("late", F.col("at") * 2 >= F.col("n"))
    blocks = listed.groupBy(*_BLOCK).agg(F.min("at").alias("least_at"), F.count(F.lit(1)).alias("n_groups")).withColumn(
        "salts", F.ceil(F.col("n_groups") / _BLOCK_ROWS).cast("int"))
    blocks = materialize(blocks, "rec-blocks")
    salted = listed.join(blocks.select(*_BLOCK, "salts"), list(_BLOCK)).withColumn("_salt", F.pmod(F.xxhash64("group_id"), "salts").cast("int"))
    return materialize(salted.drop("salts"), "rec-entries"), blocks


def _bound(n_known: Column, left: Column, n: Column) -> Column:
    """Best base score of a posting whose first shared skill, by rarity, has ``left`` skills from it on."""
    return F.least(n_known, left) / n


def _reached(best: DataFrame, k: int) -> DataFrame:
    """(class_id, reached): the k-th score of classes that have k postings; ``best`` holds at most k of each."""
    scores = best.groupBy("class_id").agg(F.count(F.lit(1)).alias("_n"), F.min("match_score").alias("reached"))
    return scores.where(F.col("_n") >= k).drop("_n")


def _search_order(classes: DataFrame, blocks: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """The blocks of each class's skills that can reach its list, with their bound.

    ``first``: the best ones, until they hold 4 k groups; their scores are enough to rule out most others.
    """
    asked = classes.select("class_id", "_junior", F.size("_known").alias("n_known"), F.explode("_known").alias("skill"))
    base = _bound(F.col("n_known"), F.col("n") - F.col("least_at"), F.col("n"))
    bounded = (
        asked.join(blocks, "skill").withColumn("bound", _percent(base, F.col("entry"), F.col("_junior"), F.col("visa")))
        .join(_reached(best, k), "class_id", "left").where(F.col("bound") >= F.coalesce("reached", F.lit(0.0)))
    )
    order = Window.partitionBy("class_id").orderBy(F.desc("bound"), "n", "skill", "late", "entry", "visa")
    before = F.coalesce(F.sum("n_groups").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return bounded.withColumn("first", before < 4 * k).select("class_id", *_BLOCK, "salts", "bound", "first")


def _meet(wanted: DataFrame, classes: DataFrame, entries: DataFrame, best: DataFrame, k: int, met: Observation | None) -> DataFrame:
    """Scores of the postings in the wanted blocks that reach the k-th score of their class.

    A class meets a group in one place only: at the first of the group's skills, by rarity, that it knows.
    """
    reached = F.coalesce("reached", F.lit(0.0))
    known = classes.select("class_id", "_known", "_junior", F.size("_known").alias("n_known")).join(_reached(best, k), "class_id", "left")
    spread = wanted.join(known, "class_id").where(F.col("bound") >= reached).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    base = F.size(F.array_intersect("by_rarity", "_known")) / F.col("n")
    could = boosted(_bound(F.col("n_known"), F.col("n") - F.col("at"), F.col("n")), F.col("entry"), F.col("_junior"), F.col("visa"))
    shared = F.filter("by_rarity", lambda s: F.array_contains("_known", s))
    pairs = (
        entries.join(spread, [*_BLOCK, "_salt"])
        .where(could * 100 + 0.1 >= reached)  # scores are rounded to one decimal
        .where(F.element_at(shared, 1) == F.col("skill"))
    )
    if met is not None:
        pairs = pairs.observe(met, F.count(F.lit(1)).alias("pairs"))
    return (
        pairs.withColumn("match_score", _percent(base, F.col("entry"), F.col("_junior"), F.col("visa")))
        .where(F.col("match_score") >= reached)
        .select("class_id", F.explode("seqs").alias("ingest_seq"), "match_score")
    )


def recommend_users(users: DataFrame, postings: DataFrame, k: int = 10, met: dict | None = None) -> DataFrame:
    """Best k postings of every user: (user_id, ingest_seq, match_score, rank).

    Exact, ties by arrival. Users with the same known skills share a class and
    postings with the same skills and boosts share a group, so only distinct
    classes meet distinct groups. A skill's groups lie in blocks whose best possible
    score is known: a class first meets its best blocks, then those only that can
    reach its k-th score so far. ``met`` is filled with the numbers of classes, groups
    and pairs of both that were compared.
    """
    members = materialize(_representatives(postings, k), "rec-members")
    tagged = materialize(_user_classes(users).select("user_id", "class_id", "_known", "_junior"), "rec-users")
    classes = materialize(
        tagged.groupBy("class_id").agg(F.first("_known").alias("_known"), F.first("_junior").alias("_junior")),
        "rec-classes",
    )
    groups = members.groupBy("group_id", "skill_names", "entry", "visa").agg(
        F.array_sort(F.collect_list("ingest_seq")).alias("seqs")  # at most k
    )
    groups = materialize(_by_rarity(groups), "rec-groups")
    entries, blocks = _entries(groups.where(F.size("skill_names") > 0))

    # Postings without skills score the same for every class of one kind: at most 4 groups of k.
    blank = groups.where(F.size("skill_names") == 0).select(
        F.explode("seqs").alias("ingest_seq"), "entry", "visa"
    )
    blank = blank.agg(F.collect_list(F.struct("ingest_seq", "entry", "visa"))).scalar()
    blanks = classes.select("class_id", "_junior", F.explode(blank).alias("p")).select(
        "class_id", F.col("p.ingest_seq").alias("ingest_seq"),
        _percent(F.lit(0.5), F.col("p.entry"), F.col("_junior"), F.col("p.visa")).alias("match_score"),
    )
    best = materialize(_best(blanks, k).drop("rank"), "rec-best")

    todo = materialize(_search_order(classes, blocks, best, k), "rec-order")
    watched = []
    for step in ("first", "NOT first"):
        watched.append(Observation() if met is not None else None)
        found = _meet(todo.where(step), classes, entries, best, k, watched[-1])
        best = materialize(_best(best.unionByName(found), k).drop("rank"), "rec-best")
    if met is not None:
        met.update(classes=classes.count(), groups=groups.count(), pairs=sum(w.get["pairs"] for w in watched))

    # A posting without a shared skill scores by its boosts alone.
    done = _reached(best, k).where(F.col("reached") > _MAX_BOOST)
    open_classes = materialize(classes.join(done, "class_id", "left_anti"), "rec-open")
    if not open_classes.isEmpty():
        best = materialize(_best(best.unionByName(_without_overlap(open_classes, members, k)), k).drop("rank"), "rec-best")
    return tagged.select("user_id", "class_id").join(_best(best, k), "class_id").select(
        "user_id", "ingest_seq", "match_score", "rank"
    )


def _without_overlap(open_classes: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The best postings that share no skill, for classes that still have room.

    Such a posting scores by its boosts alone, so per kind (junior, visa) the
    first k in order of arrival are enough. Most classes find them among the first
    ``_HEAD`` postings of a kind. Those that do not know so many skills that few
    skills are left outside: they are joined with the postings whose first skill is
    one of these. The number of jobs does not depend on the number of rows.
    """
    listed = members.where(F.size("skill_names") > 0)
    head = top_per_group(listed, ["entry", "visa"], _HEAD, [F.asc("ingest_seq")]).drop("rank")
    kinds = materialize(
        head.groupBy("entry", "visa").agg(F.array_sort(F.collect_list(F.struct("ingest_seq", "skill_names"))).alias("list")),
        "rec-head",
    )
    kinds = kinds.agg(F.collect_list(F.struct("entry", "visa", "list"))).scalar()  # at most 4 lists
    free = F.filter("kind.list", lambda p: ~F.arrays_overlap(p["skill_names"], F.col("_known")))
    step = open_classes.withColumn("kind", F.explode(kinds)).select(
        "class_id", "_known", "_junior", "kind.entry", "kind.visa", F.size("kind.list").alias("_seen"),
        F.slice(F.transform(free, lambda p: p["ingest_seq"]), 1, k).alias("_free"),
    )
    step = materialize(step, "rec-fill")
    score = _percent(F.lit(0.0), F.col("entry"), F.col("_junior"), F.col("visa")).alias("match_score")
    found = step.select("class_id", F.explode("_free").alias("ingest_seq"), "entry", "visa", "_junior")

    terms = listed.select(F.explode("skill_names").alias("s")).distinct().agg(F.collect_list("s")).scalar()  # the taxonomy
    short = step.where((F.size("_free") < k) & (F.col("_seen") == _HEAD))
    outside = short.select("class_id", "_known", "_junior", "entry", "visa", F.explode(F.array_except(terms, F.col("_known"))).alias("_s"))
    more = (
        listed.withColumn("_s", F.element_at("skill_names", 1))
        .join(outside, ["_s", "entry", "visa"])
        .where(~F.arrays_overlap("skill_names", "_known"))
        .select("class_id", "ingest_seq", "entry", "visa", "_junior")
    )
    more = top_per_group(more, ["class_id", "entry", "visa"], k, [F.asc("ingest_seq")]).drop("rank")
    # The joined postings hold those already found once more.
    return found.unionByName(more).distinct().select("class_id", "ingest_seq", score)
