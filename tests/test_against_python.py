"""Random inputs against small plain-Python statements of the same rule."""

import random
import re

from pyspark.sql import functions as F

from hirescope.operators import recommend, skills
from hirescope.operators.skills import contained_terms


def test_skill_counts(make, cfg):
    rng = random.Random(3)
    odd = ["für", "é", "_", "x_", "c++11", "c#7", "K8S", "ſql", "²", " ", "\n", "-", "/", ".", "&", "ﬁ", "日本", "̈"]
    pieces = list(cfg.skills) + odd + ["Required", "must have", "R", "go", "lead gen", "sql server sql"]
    texts = []
    for _ in range(150):
        joiner = rng.choice([" ", "", ", ", " - "])
        words = [rng.choice([str.upper, str.title, str])(rng.choice(pieces)) for _ in range(rng.randrange(1, 25))]
        texts.append(joiner.join(words))
    df = make(*[{"title": t, "description": ""} for t in texts])
    got = {r["ingest_seq"]: {s["name"]: s["count"] for s in r["skills"]} for r in skills.extract_skills(df, cfg).collect()}
    for i, t in enumerate(texts):
        t = t + " "
        want = {}
        for term in cfg.skills:
            n = len(re.findall(r"\b" + re.escape(term) + r"\b", t, re.IGNORECASE))
            if n:
                want[term] = n
        assert got[i] == want, t
    assert contained_terms(cfg)


def test_required(make, cfg):
    rng = random.Random(5)
    pieces = ["required", "essential ", "\n", "sql", "python", " ", "minimum", "go", "must have", "x", "qualifications", "api"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "", "\n"]) for _ in range(12)) for _ in range(120)]
    df = make(*[{"title": t, "description": ""} for t in texts])
    for r in skills.extract_skills(df, cfg).collect():
        low = texts[r["ingest_seq"]].lower()
        for s in r["skills"]:
            want = any(re.search(m + ".*?" + re.escape(s["name"]), low) for m in ("required", "must have", "essential", "minimum", "qualifications"))
            assert s["is_required"] == want, (low, s)


def brute(users, posts, k):
    result = {}
    for uid, mine, years in users:
        mine = {m.lower() for m in mine}
        scores = []
        for seq, names, level, visa in posts:
            s = 0.5 if not names else len(mine & set(names)) / len(names)
            if any(w in (level or "").lower() for w in ("entry", "junior", "graduate")) and (years or 0) <= 3:
                s = min(s + 0.1, 1.0)
            if visa:
                s = min(s + 0.05, 1.0)
            scores.append((-round(s * 100, 1), seq))
        result[uid] = [(seq, -score) for score, seq in sorted(scores)[:k]]
    return result


def check_users(spark, users, posts, k, met=None):
    posts_df = spark.createDataFrame(posts, "ingest_seq BIGINT, skill_names ARRAY<STRING>, experience_level STRING, visa_sponsorship BOOLEAN")
    users_df = spark.createDataFrame(users, "user_id BIGINT, skills ARRAY<STRING>, experience_years INT")
    got = {}
    for r in recommend.recommend_users(users_df, posts_df, k, met).orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append((r["ingest_seq"], r["match_score"]))
    assert got == brute(users, posts, k)


def test_many_users(spark, cfg):
    rng = random.Random(11)
    terms = list(cfg.skills[:14])
    levels = ["Entry-Level", "Senior", None]
    posts = [(i, sorted(rng.sample(terms, rng.choice([0, 1, 2, 3, 5, 8]))), rng.choice(levels), rng.random() < 0.4) for i in range(120)]
    users = [(u, [t.upper() for t in rng.sample(terms + ["juggling"], rng.choice([1, 2, 4, 9]))], rng.choice([0, 3, 4, None])) for u in range(40)]
    check_users(spark, users, posts, 6)


def test_few_pairs_are_compared(spark, cfg, monkeypatch):
    monkeypatch.setattr(recommend, "_BLOCK_ROWS", 20)  # several salts a block
    rng = random.Random(17)
    terms = list(cfg.skills[:40])
    # Skills by a steep law, so that the common ones are in most postings and users.
    weights = [1 / (i + 1) for i in range(40)]
    draw = lambda n: sorted(set(rng.choices(terms, weights, k=n)))
    posts = [(i, draw(rng.choice([2, 4, 6, 9, 14])), rng.choice(["Junior", "Senior"]), rng.random() < 0.3) for i in range(1500)]
    users = [(u, draw(rng.choice([2, 3, 5])), rng.choice([1, 8])) for u in range(120)]
    met = {}
    check_users(spark, users, posts, 10, met)
    assert met["pairs"] < 0.15 * met["classes"] * met["groups"], met


def test_users_who_share_nothing(spark, cfg, monkeypatch):
    monkeypatch.setattr(recommend, "_HEAD", 3)
    rng = random.Random(13)
    # No posting is without skills, and most share one skill: few users can fill their list by overlap.
    posts = [(i, ["sql"] + rng.sample(["python", "dbt", "excel"], rng.randrange(3)) if i % 5 else ["go", "rust"],
              rng.choice(["Junior", "Senior"]), rng.random() < 0.5) for i in range(40)]
    posts = [(i, sorted(names), level, visa) for i, names, level, visa in posts]
    users = [(0, ["juggling"], 1), (1, ["sql"], 1), (2, ["go"], 9), (3, ["rust", "sql"], 2), (4, [], 1), (5, ["dbt"], 5)]
    check_users(spark, users, posts, 9)


def test_fewer_postings_than_asked(spark, cfg):
    check_users(spark, [(1, ["sql"], 1), (2, ["go"], 1)], [(5, ["sql"], "Junior", False), (6, [], None, True)], 4)
