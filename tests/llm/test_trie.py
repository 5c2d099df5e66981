"""Prefix trie of conversations against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from hirescope.llm import trie

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(convs):
    """Nodes of {conv_id: [(role, text), ...]} as a set of rows."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = set()
    for node, ids in members.items():
        below = [m for m in members if m[: len(node)] == node]
        childless = [m for m in below if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(node))
        rows.add((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids),
                  sum(len(m) == len(node) + 1 for m in below), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def plain_crossed(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    return out


def table(spark, convs):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, TURNS).repartition(3)


def random_convs(seed, n, words=("a", "b", "cé"), longest=6):
    rng = random.Random(seed)
    return {c: [("u" if i % 2 else "v", rng.choice(words)) for i in range(rng.randint(1, longest))] for c in rng.sample(range(3 * n), n)}


def nodes_of(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize(("seed", "n", "blocks"), [(1, 40, 1), (2, 120, 7), (3, 120, 30)])
def test_equals_brute_force_however_it_is_cut(spark, seed, n, blocks):
    convs = random_convs(seed, n)
    got = trie.prefix_trie(trie.crossed(trie.numbered(table(spark, convs))), least_blocks=blocks)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert nodes_of(got) == plain_trie(plain_crossed(convs))


def test_one_conversation_over_many_blocks(spark):
    """Conversations all alike, and longer ones after them, with ends that blocks split."""
    same = [("u", "hello"), ("a", "there"), ("u", "again")]
    convs = {c: list(same) for c in range(150)} | {200 + i: same + [("a", str(i % 3))] for i in range(30)} | {300: same[:1], 301: same[:1]}
    said = trie.numbered(table(spark, convs))
    got = trie.prefix_trie(said.unionByName(trie.marks(said)), least_blocks=16)
    assert nodes_of(got) == plain_trie(convs)


def test_blocks_by_hand():
    """All ways to cut sorted sequences in two give shares that add up."""
    rng = random.Random(5)
    seqs = sorted(bytes(x for t in range(rng.randint(0, 5)) for x in [rng.choice([1, 2])] * 16) for _ in range(12))
    ids, sizes = np.array(rng.sample(range(100), 12)), [np.full(len(s) // 16, 3) for s in seqs]
    whole = trie.block_nodes(seqs, ids, sizes, None, None)
    assert not any(whole["open"].to_pylist())
    want = sorted(zip(*[whole[c].to_pylist() for c in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]))
    for cut in range(1, 12):
        a = trie.block_nodes(seqs[:cut], ids[:cut], sizes[:cut], None, seqs[cut])
        b = trie.block_nodes(seqs[cut:], ids[cut:], sizes[cut:], seqs[cut - 1], None)
        rows, over = [], {}
        for part in (a, b):
            for is_open, key, d, c, *n in zip(*[part[k].to_pylist() for k in (
                    "open", "key", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]):
                if is_open:
                    old = over.get(key, (d, c, 0, 0, 0, 0))
                    over[key] = (d, min(c, old[1]), *[x + y for x, y in zip(n, old[2:])])
                else:
                    rows.append((d, c, *n))
        assert sorted(rows + list(over.values())) == want


def test_extents_are_those_of_a_scan():
    values = np.random.default_rng(0).integers(0, 4, 37)
    table_ = trie.RangeMin(values)
    at = np.repeat(np.arange(38), 5)
    depth = np.tile(np.arange(5), 38)
    left, right = table_.extents(at, depth)
    for i, d, l, r in zip(at, depth, left, right):
        a = b = i
        while a > 0 and values[a - 1] >= d:
            a -= 1
        while b < 37 and values[b] >= d:
            b += 1
        assert (a, b) == (l, r)


def test_edge_cases(spark):
    rows = [(1, None, "u", "x"), (1, 0, None, None), (1, 0, "", "b"), (2, None, "u", "x"), (2, 0, "", ""), (2, 0, "", "b"),
            (None, 0, "u", "lost"), (3, 1, "u", "x"), (3, 1, "u", "x"), (4, 0, "u|", "é" * 20_000)]
    turns = spark.createDataFrame([(*r, 7, "s") for r in rows], TURNS + ", place long, seq string")
    said = trie.numbered(turns)
    got = nodes_of(trie.prefix_trie(said.unionByName(trie.marks(said))))
    convs = {1: [("u", "x"), ("", ""), ("", "b")], 2: [("u", "x"), ("", ""), ("", "b")], 3: [("u", "x"), ("u", "x")], 4: [("u|", "é" * 20_000)]}
    assert got == plain_trie(convs)
    # Conversation 1 of h = 3 or more loses all its turns and its base is absent: it has no turn and stays.
    lone = {c: [("u", "x")] for c in range(1, 5)}
    want = plain_crossed(lone)
    assert any(not t for t in want.values())
    assert nodes_of(trie.prefix_trie(trie.crossed(trie.numbered(table(spark, lone))))) == plain_trie(want)
    assert trie.prefix_trie(trie.crossed(trie.numbered(turns.where("false")))).collect() == []


def test_role_and_text_do_not_run_together(spark):
    convs = {1: [("ab", "c")], 2: [("a", "bc")], 3: [("1:a", "")], 4: [("1", ":a")]}
    said = trie.numbered(table(spark, convs))
    assert trie.prefix_trie(said.unionByName(trie.marks(said))).where("depth = 1").count() == 4
