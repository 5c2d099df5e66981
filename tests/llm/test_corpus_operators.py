"""Near duplicates, scoring, chat, top-k and the pipeline against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from llm_cases import EDGES, docs  # noqa: F401  (docs is a fixture)
from pyspark.sql import functions as F

import corpus_pipeline
from hirescope.llm import chat, langid, neardup, packing, pii, pst, queries, topk
from hirescope.llm.common import KeyTable

public_tokenizers = pytest.importorskip("public_tokenizers")


def noise(rng, n):
    return ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]


# Jaccard join


def by_brute_force(rows):
    """(doc_id, class_id, n_links) of rows in order."""
    sets = [set(neardup.grams((text or "").encode()).tolist()) for _, text, *_ in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= neardup.SIMILARITY * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(((rows[i][0], rows[find(i)][0], links[i]) for i in range(n)), key=repr)


def near_rows(seed):
    rng = random.Random(seed)
    rows = []
    for group in range(12):
        words = noise(rng, rng.choice([3, 8, 40, 120]))
        for _ in range(rng.choice([1, 2, 5, 9])):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = "changed%d" % rng.randrange(3)
            rows.append((len(rows), " ".join(own)))
    passage = " ".join(noise(rng, 60))
    rows += [(len(rows) + i, " ".join(noise(rng, 80)) + " " + passage) for i in range(20)]
    return rows


@pytest.mark.parametrize(("leaf", "block"), [(64, 256), (3, 2)])
def test_classes_and_links(spark, docs, monkeypatch, leaf, block):
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_rows(1)
    got = neardup.near_duplicates(docs(*rows).coalesce(1)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=repr) == by_brute_force(rows)


def test_large_near_group_is_whole(spark, docs, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 8)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(3)
    words = noise(rng, 200)
    rows = []
    for i in range(120):
        own = list(words)
        own[rng.randrange(200)] = f"w{i}"
        rows.append((i, " ".join(own)))
    got = neardup.near_duplicates(docs(*rows)).collect()
    assert {r["class_id"] for r in got} == {0}
    # All 7,140 pairs have 0.9: hardly one is separated in all runs.
    assert sum(r["n_links"] for r in got) >= 0.999 * 120 * 119


def test_pairs_at_the_least_similarity_meet(spark, docs, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 8)
    rng = random.Random(8)
    words = noise(rng, 184)
    rows = []
    for i in range(160):
        own = list(words)
        # Ten grams of 180 differ in each: 160 of 200 are shared where they are apart.
        at = 4 + rng.randrange(176)
        own[at], own[4 + (at + 30) % 176] = f"v{i}", f"w{i}" if i % 4 else own[4 + (at + 30) % 176]
        rows.append((i, " ".join(own)))
    want = sum(n for *_, n in by_brute_force(rows))
    got = sum(r["n_links"] for r in neardup.near_duplicates(docs(*rows)).collect())
    assert neardup.separated(neardup.SIMILARITY) ** neardup.RUNS <= 1 - neardup.RECALL
    assert want > 10_000 and 0.998 * want <= got <= want


def test_near_duplicate_edges(spark, docs):
    got = [(r["doc_id"], r["n_links"]) for r in neardup.near_duplicates(docs(*EDGES)).collect()]
    assert Counter(got) == Counter([(1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (None, 0), (5, 0), (6, 0), (7, 0), (8, 0)])
    assert neardup.near_duplicates(docs()).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(101, 100), (103, 101)], "a long, b long")
    got = {(r["a"], r["b"]) for r in neardup.components(edges).collect()}
    assert got == {(i, 0) for i in range(1, 61)} | {(101, 100), (103, 100)}


# Scoring


def test_base_score_counts_and_gain(spark, docs):
    rng = random.Random(5)
    follow = {"the": ["cat", "dog"], "a": ["tree", "house"]}
    rows = []
    for i in range(200):
        words = []
        for _ in range(30):
            w = rng.choice(["the", "a"])
            words += [w, rng.choice(follow[w])]
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, text) for i, (_, text, *_) in enumerate(EDGES)]
    table = docs(*rows)
    tree, counts = pst.learn(table.where(~pst.held_out()))
    got = {r["doc_id"]: r for r in pst.score(table, tree, counts).collect()}
    train = [text or "" for i, text in rows if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in pst.words_of(t.encode()))
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, text in rows:
        words = pst.words_of((text or "").encode())
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in [*(c[w] for w in words), len(train)])
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words) + 1, sum(c[w] > 0 for w in words) + 1, n)
        assert r["base_score"] == pytest.approx(base)
    assert len(tree.leave) > 2
    assert all(got[i]["score"] > got[i]["base_score"] + 10 for i in range(200))
    # What a state gives to all tokens sums to one.
    for state in range(len(tree.leave)):
        assert total(tree, state) == pytest.approx(1)


def total(tree, state):
    counts = np.append(tree.counts, [tree.ends]).astype(float)
    token = np.append(tree.symbols[: len(tree.counts)], pst._END)
    p, unknown = tree.root(counts), tree.root(np.zeros(1))[0]
    chain = []
    while state >= 0:
        chain.append(state)
        state = int(tree.parent[state])
    for s in chain[::-1]:
        p, unknown = p * 10 ** tree.leave[s], unknown * 10 ** tree.leave[s]
        at = tree.listed.find(((s << pst._BITS) | token).astype(np.uint64))
        hit = (at != tree.listed.none) & (token > 0)
        p[hit] = 10 ** tree.logp[at[hit]]
    return p.sum() + unknown


def test_rare_words_go_through_the_join(spark, docs, monkeypatch):
    monkeypatch.setattr(pst, "P_WORD", 0.05)
    rows = [(i, "common common rare%d" % (i // 2)) for i in range(40)]
    table = docs(*rows)
    tree, counts = pst.learn(table)
    assert set(tree.words) == {b"common"}
    got = {r["doc_id"]: r for r in pst.score(docs(*rows, (99, "unseen common")), tree, counts).collect()}
    n, v = 160, 22
    p = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    assert got[3]["base_score"] == pytest.approx(2 * p(80) + p(2) + p(40)) and got[3]["n_known"] == 4
    assert got[99]["base_score"] == pytest.approx(p(0) + p(80) + p(40)) and got[99]["n_known"] == 2


def tree_by_brute_force(texts, root):
    """Retained contexts, of any length: what they list, and the weight of all else."""
    rows, tree, level = [["<s>", *t.split(), "</s>"] for t in texts], {(): (None, 1.0)}, 1
    while True:
        follow = {}
        for row in rows:
            for i in range(level, len(row)):
                follow.setdefault(tuple(row[i - level : i]), Counter())[row[i]] += 1
        new = {}
        for context, tokens in follow.items():
            if context[1:] not in tree:
                continue
            total, above = sum(tokens.values()), tree[context[1:]][0]
            cells = {t: (n, root[t] if above is None else above[t]) for t, n in tokens.items() if n > 1}
            rest, had = total - sum(n for n, _ in cells.values()), max(1 - sum(b for _, b in cells.values()), 1e-12)
            ratio = sum(n * math.log(n / total / b) for n, b in cells.values()) + (rest * math.log(rest / total / had) if rest else 0)
            if cells and ratio >= max(pst.EVIDENCE, pst.DIVERGENCE * total):
                given = {t: (n + pst.MU * b) / (total + pst.MU) for t, (n, b) in cells.items()}
                new[context] = given, (rest / had + pst.MU) / (total + pst.MU)
        if not new:
            return tree
        tree.update(new)
        level += 1


@pytest.mark.parametrize("head, share", [(1 << 20, 1e-6), (3, 1e-6), (3, 0.02)])
def test_contexts_of_any_length_and_rarity(spark, docs, monkeypatch, head, share):
    monkeypatch.setattr(pst, "HEAD", head)
    monkeypatch.setattr(pst, "P_WORD", share)
    rng = random.Random(8)
    letters = [f"w{i}" for i in range(12)]
    texts = []
    for i in range(400):
        words = [rng.choice(letters) for _ in range(30)]
        # Each of the four words before a sum tells more of it.
        for bits in (rng.choices((0, 1), k=4) for _ in range(6)):
            words += [*("ab"[x] for x in bits), f"s{sum(bits)}"]
        texts.append(" ".join([*words, f"rare{i // 8}", f"next-to-the-rare{i // 8}"]))
    table = docs(*enumerate(texts))
    tree, counts = pst.learn(table)
    got = {r["doc_id"]: r for r in pst.score(docs(*enumerate(texts), (1000, "a b b a s2 unseen rare3 b b b b s1")), tree, counts).collect()}
    c = Counter(t for text in texts for t in [*text.split(), "</s>"])
    root = {t: (x + 0.1) / (sum(c.values()) + 0.1 * (len(c) + 1)) for t, x in c.items()}
    want = tree_by_brute_force(texts, root)
    assert max(map(len, want)) == tree.levels >= 4 and any("rare" in context[-1] for context in want if context)
    for i, text in [*enumerate(texts), (1000, "a b b a s2 unseen rare3 b b b b s1")]:
        row, full = ["<s>", *text.split(), "</s>"], 0.0
        for j in range(1, len(row)):
            k = 0
            while k < j and tuple(row[j - k - 1 : j]) in want:
                k += 1
            p = 1.0
            while k and row[j] not in want[tuple(row[j - k : j])][0]:
                p *= want[tuple(row[j - k : j])][1]
                k -= 1
            full += math.log10(p * (want[tuple(row[j - k : j])][0][row[j]] if k else root.get(row[j], 0.1 / (sum(c.values()) + 0.1 * (len(c) + 1)))))
        assert got[i]["score"] == pytest.approx(full)


def test_the_driver_sorts_no_rows_for_the_head(spark, docs, monkeypatch):
    kind = type(spark.range(0))
    few = kind.limit
    monkeypatch.setattr(kind, "limit", lambda df, n: few(df, n) if n < 50 else pytest.fail("top rows meet in the driver"))
    monkeypatch.setattr(pst, "HEAD", 50)
    rng = random.Random(3)
    tree, _ = pst.learn(docs(*((i, " ".join(f"{rng.choice('abcd')}{x}" for x in rng.choices(range(9), k=40) for _ in "12")) for i in range(200))))
    assert 0 < len(tree.over) <= 60 and 0 < len(tree.leave) <= 60


def test_the_head_holds_the_highest_counts(spark, monkeypatch):
    monkeypatch.setattr(pst, "HEAD", 1000)
    rows = spark.range(20_000).selectExpr("id as key", "cast(20000 / (id + 1) as long) + 1 as n")
    got = sorted(r["key"] for r in pst._most(rows, "n", "key").collect())
    # Counts of 21 and 20 lie at the edge.
    assert 900 <= len(got) <= 1020 and set(range(900)) <= set(got)


def test_only_pairs_that_may_tell_more_are_tried_as_contexts(spark):
    states = spark.createDataFrame([(7, 100)], "w long, total long").select(pst._of_word("w").alias("ctx"), "total")
    # The word 7 is seen 100 times: after 11 to 14 so often. 100 ln(1.2) and 13 ln(120 / 13) are under 30.
    counted = spark.createDataFrame([(11, 7, 100), (12, 7, 40), (13, 7, 13), (14, 7, 15), (15, 8, 90), (7, 0, 100)], "ctx long, pair long, n long")
    assert sorted(r["total"] for r in pst._two_words(counted, states).collect()) == [15, 40]


def test_counts_travel_as_few_bytes_and_none_is_lost():
    """Counts of pairs take less than 13 bytes each (20 when context, pair and count stood in full); those of all tasks add up."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rng = random.Random(4)
    texts = [" ".join(f"w{int(1 / (1e-4 + rng.random()))}" for _ in range(200)) for _ in range(200)]
    words = [f"w{i}" for i in range(40)]
    known = KeyTable(pst.word_hashes(*pst.utf8(pa.array([" ".join(words)])))[0])
    halves = [pa.RecordBatch.from_arrays([pa.array(x)], names=["text"]) for x in (texts[:90], texts[90:])]
    for level in (1, 2, 3):
        bits = np.full(1 << 24, 255, np.uint8)
        sent = [b for x in halves for b in pst._gram_counts(level, 1, level > 2, 20, bits, None, known, iter([x]))]
        rows = pa.Table.from_batches(sent)
        cells = [(w, p, n) for i in range(20) for part in [rows.filter(pc.equal(rows["bucket"], i))] if len(part)
                 for w, p, n in zip(*pst._summed(level, known, part).to_pydict().values())]
        pairs = sum(r["rows"] for r in rows.to_pylist() if r["heads"])
        assert sum(len(r[c]) for r in rows.to_pylist() if r["heads"] for c in ("word", "size", "pair", "n")) < 13 * pairs
        follow, whole = Counter(), Counter()
        for t in texts:
            row = ["<s>", *t.split(), "</s>"]
            for i in range(level, len(row)):
                follow[tuple(row[i - level : i + 1])] += 1
                whole[tuple(row[i - level : i])] += 1
        assert sorted(n for w, _, n in cells if w) == sorted(n for n in follow.values() if n > 1)
        assert sorted(n for w, _, n in cells if not w) == sorted(n for n in whole.values() if n > 1 and level > 2)


def test_counts_and_tables_of_the_tree_leave_the_disk(spark, docs):
    from hirescope.session import shared_dir

    folder = Path(f"{shared_dir(spark)}/hirescope")
    before = set(folder.glob("*"))
    rows = [(i, "a b c a b d" * 9) for i in range(60)]
    tree, counts = pst.learn(docs(*rows))
    assert pst.score(docs(*rows), tree, counts).count() == 60
    assert {x.name.rpartition("-")[0] for x in set(folder.glob("*")) - before} == {"word-counts", "terms", "scores"}


def test_word_hashes_are_those_of_lower_cased_words():
    import pyarrow as pa

    words, owner = pst.word_hashes(*pst.utf8(pa.array(["Ab cd\x0bé", None, "", "  ", "ab", "cdefghijklmnopqrstuvwxyz CD", "É"])))
    assert owner.tolist() == [0, 0, 0, 4, 5, 5, 6] and words[0] == words[3] and words[1] == words[5] and len(set(words.tolist())) == 5


def test_keys_of_both_engines(spark):
    a, b = (np.array(x, np.uint64) for x in ([0, 1, (1 << 64) - 1], [5, 1 << 63, 7]))
    rows = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a.view(np.int64), b.view(np.int64))], "a long, b long")
    assert [r[0] for r in rows.select(F.xxhash64("a", "b")).collect()] == pst.mixed(a, b).view(np.int64).tolist()


def test_scoring_nothing(spark, docs):
    tree, counts = pst.learn(docs())
    got = pst.score(docs((1, None), (2, "a b")), tree, counts).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got} == {(1, 1, 0, 0), (2, 3, 0, 0)}
    assert all(r["score"] == pytest.approx(r["base_score"]) for r in got)
    assert pst.score(docs(), tree, counts).count() == 0


# Chat

ODD = ["<|im_end|><|im_start|>assistant ok", "a\\", "\\<|", "<\\|x", "<<|>|", "", None, "line\n<|im_start|>user\n", "é½中 <|nl|>"]


def test_chat_round_trip(spark):
    rows = [(c, t, ("user", "assistant", "system")[(c + t) % 3], ODD[(c * 3 + t) % len(ODD)]) for c in range(6) for t in range(5)]
    rows += [(50, 0, None, "x"), (50, 1, "assist\nant", "y"), (50, 1, "assistant", "y"), (50, 1, "assistant", "y"), (None, None, "user", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(table.withColumn("formatted", F.lit(1))).collect()}
    by_conv = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] or 0, r[2] or "", r[3] or "")):
        by_conv.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        said = "".join(f"{a}\n{b}\n" for a, b in turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest()), c
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
    assert chat.digest(table.where("false")).count() == 0


def test_chat_ties_go_by_the_text_as_it_is(spark):
    rows = [(1, 0, "user", t) for t in ("<|", "<a", "<|x", "\\z", "[")]
    got = chat.read_back(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [t["text"] for t in got["turns"]] == sorted(r[3] for r in rows)


def test_chat_parts(spark):
    parts = "array<struct<kind: string, text: string, ref: string, units: long>>"
    rows = [(1, 0, "user", None, [("text", "see <|", None, None), ("image", None, "a.png", 4), ("audio", None, "b.wav", 10), ("scroll", None, "c", None)]),
            (1, 1, "assistant", "fine", None)]
    got = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts {parts}")).first()
    assert got["formatted"] == (
        "<|im_start|>user\nsee <\\|<|image|><|audio|><|document|><|im_end|>\n<|im_start|>assistant\nfine<|im_end|>\n")
    assert [tuple(a) for a in got["attachments"]] == [(0, "image", "a.png", 1024), (0, "audio", "b.wav", 250), (0, "document", "c", 512)]
    assert [got["formatted"][s["start"] : s["start"] + s["length"]] for s in got["spans"] if s["loss"]] == ["fine"]


def test_chat_uses_no_python(spark):
    table = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digest(table)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# Top k


def test_bounds_drop_candidates():
    rng = np.random.default_rng(1)
    plain = rng.normal(size=(3000, 64))
    plain = np.floor(64 * plain / np.linalg.norm(plain, axis=1, keepdims=True))
    shares = topk.survivors(plain[::30], plain)
    assert shares == sorted(shares, reverse=True) and shares[-1] < 0.5
    # Energy in few segments: the coarse levels drop nearly all.
    smooth = np.floor(64 * np.repeat(rng.normal(size=(3000, 4)), 16, axis=1))
    assert topk.survivors(smooth[::30], smooth)[1] < 0.05


@pytest.mark.parametrize("block", [(16_384, 1_024), (7, 3)])
def test_top_k_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block[0])
    monkeypatch.setattr(topk, "QUERY_BLOCK", block[1])
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=10)]) for i in range(60)]
    vectors += [(60, vectors[0][1]), (61, vectors[0][1]), (20, vectors[3][1]), (62, None), (63, [1.0] * 9 + [None]), (64, [math.nan] * 10),
                (65, [math.inf] * 10), (66, []), (None, [1.0] * 10), (67, [0.0] * 10), (80, [1.0, 2.0]), (81, [3.0, -1.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.search(table, "vec_id % 20 = 0", k=5).collect()))
    usable = [(i, v) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, (i, v) in enumerate(usable):
        if i % 20 == 0:
            scores = [(-sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(v, w)), j, k)
                      for k, (j, w) in enumerate(usable) if k != q and len(w) == len(v)]
            want += [(i, rank, j, -s) for rank, (s, j, _) in enumerate(sorted(scores)[:5], 1)]
    assert got == sorted(want)
    assert topk.search(table.where("false"), "vec_id % 20 = 0").count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(40, 19)), rng.normal(size=(30, 19))
    exact = a @ b.T
    for level in topk.LEVELS:
        assert (topk.features(a, level) @ topk.features(b, level).T >= exact - 1e-9).all()


def test_large_components_stay_exact():
    a = np.array([[2.0**40, 1.0], [1.0, 3.0]])
    assert topk._exact(a, a.T).tolist() == [[2**63 - 1, 2**40 + 3], [2**40 + 3, 10]]


# The pipeline


def corpus(seed=4):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(["the", "and", "of"]) + w for w in noise(rng, 60))) for i in range(40)]
    near = rows[0][1].split()
    near[30] = "changed"
    rows += [(100, rows[0][1]), (101, " ".join(near)), (102, "12 34 --"), (103, "too short"), (104, None),
             (105, " ".join(noise(rng, 60)) + " mail x.y@z.org now"), (106, rows[7][1]), (106, rows[7][1])]
    return rows


def test_pipeline_against_its_stages_by_hand(spark, docs, tmp_path):
    rows = corpus()
    docs(*rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # By hand: und goes, then what is short, then all but the first of each class; then masks and ids.
    left = [r for r in rows if r[1] and any(map(str.isalpha, r[1])) and len(r[1].split()) >= 50]
    first = {c: i for i, c, _ in reversed(by_brute_force_in_order(left))}
    kept = {i: dict(left)[i] for i in first.values()}
    assert {r["doc_id"] for r in got} == set(kept) and 101 not in kept and 100 not in kept
    assert len([r for r in got if r["doc_id"] in (7, 106)]) == 1
    whole = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for r in got:
        text = pii.mask(kept[r["doc_id"]], pii.find(kept[r["doc_id"]]))
        assert r["length"] == len(whole.text(text.encode())) // 4 + 1
    assert "x.y@z.org" in kept[105]


def by_brute_force_in_order(rows):
    want = {(a, b): c for a, b, c in by_brute_force(rows)}
    return [(i, c, want[i, c]) for i, *_ in rows for (a, c) in want if a == i]


def test_marks_tell_sources_apart(spark, docs):
    table = docs((1, "same text", "en", "a"), (1, "same text", "en", "b"), (1, "same text", "en", None))
    kept = table.where("source = 'b'").select("doc_id", corpus_pipeline._hash().alias("tag"))
    assert [r["source"] for r in corpus_pipeline._staying(table, kept).collect()] == ["b"]


def test_stages_keep_the_columns(spark, docs, tmp_path):
    table = docs(*corpus(), *EDGES).withColumnsRenamed({}).withColumn("Score", F.lit("own"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars", "Score"], name
    empty = docs()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_all_thirteen_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert langid.ORDER >= 2
