"""SimHash near-duplicates against brute force."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from hirescope.functions import graph
from hirescope.llm import queries, simhash
from llm_cases import EDGES, docs  # noqa: F401

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps):
    """Least index of each fingerprint's class, by all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def close_numbers(seed, n):
    """Fingerprints of which many are a few bits from others, in chains."""
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 1 << 64, n // 4, np.uint64).tolist()
    while len(set(out)) < n:
        x = out[int(rng.integers(len(out)))]
        for bit in rng.integers(0, 64, int(rng.integers(1, 6))):
            x ^= 1 << int(bit)
        out.append(x)
    return np.array(sorted(set(out)), np.uint64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "İx", "é́", "c d", "zz"]), max_size=12), st.sampled_from([" ", "\n", " \t\x0b", "\x0c\r"]))
def test_fingerprint(words, blank):
    text = blank.join(words)
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_long_text():
    text = " ".join(f"w{i % 977}" for i in range(40_000))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("at_once", [1, 64, 1 << 18])
def test_pairs_are_those_of_all_comparisons(monkeypatch, at_once):
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    a, b = close_numbers(1, 300), close_numbers(1, 220)
    got = sorted((int(i), int(j)) for x, y in simhash.near_pairs(a, b) for i, j in zip(x, y))
    want = [(i, j) for i in range(len(a)) for j in range(len(b)) if (int(a[i]) ^ int(b[j])).bit_count() <= 3]
    assert got == want


def test_tiles_out_of_reach_are_all_that_is_skipped():
    for bits in simhash.STEPS:
        steps = simhash.neighbour_steps(bits)
        assert (np.abs(steps).sum(1) <= 3).all() and not steps[0].any()
        both = {tuple(s) for s in steps.tolist()} | {tuple(s) for s in (-steps).tolist()}
        assert len(both) == 2 * len(steps) - 1
        if bits == 32:
            assert len(both) == sum(abs(x) + abs(y) <= 3 for x in range(-3, 4) for y in range(-3, 4))


@pytest.mark.parametrize(("bits", "block"), [(32, 7), (16, 5), (8, 3)])
def test_links_join_what_all_pairs_join(spark, bits, block):
    fps = close_numbers(2, 400)
    order = np.sort(fps.view(np.int64))  # as signed numbers, so that the least node is the least index
    table = spark.createDataFrame([(int(x),) for x in order], "fp long").repartition(3)
    tiles = {r["fp"]: r["t"] for r in table.select("fp", simhash.tile_column(table["fp"], bits).alias("t")).collect()}
    numbers = simhash.tile_number(simhash.part_counts(order.view(np.uint64), bits), bits)
    assert [tiles[int(x)] for x in order] == numbers.tolist()
    joined = {r["a"]: r["b"] for r in graph.components(simhash.links(table, len(fps), block, bits)).collect()}
    want = plain_classes([int(x) & (2**64 - 1) for x in order])
    assert [joined.get(int(x), int(x)) for x in order] == [int(order[w]) for w in want]


def test_number_of_parts_grows_with_the_input():
    assert [simhash.part_bits(n) for n in (0, 10**5, 10**8, 10**11)] == [32, 32, 16, 8]


def test_components_of_odd_graphs(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    chain = [(i, i + 1) for i in range(60)] + [(5000, 5001), (5001, 5001), (7, 6)]
    star = [(10_000, 20_000 + i) for i in range(3000)]
    got = {r["a"]: r["b"] for r in graph.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 5001: 5000, **{20_000 + i: 10_000 for i in range(3000)}}


def test_edge_cases(spark, docs):  # noqa: F811
    rows = docs(*EDGES, (20, "One"), (21, "one")).withColumnsRenamed({"lang": "fp", "source": "component_id", "n_chars": "least"})
    got = simhash.near_duplicates(rows).collect()
    assert len(got) == len(EDGES) + 2
    by_id = {r["doc_id"]: r for r in got}
    blank = [by_id[i] for i in (1, 2, 3, 7)]
    assert {(r["fp"], r["component_id"]) for r in blank} == {(0, 1)}
    assert by_id[21]["component_id"] == by_id[20]["component_id"] == 4 and by_id[4]["fp"] == by_id[20]["fp"]
    assert by_id[None]["component_id"] is None
    assert simhash.digest(rows.where("false")).collect() == []


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = {r["doc_id"]: (f"{f:016x}", rows[c]["doc_id"]) for r, f, c in zip(rows, fps, plain_classes(fps))}
    got = queries.QUERIES["op11_simhash"](spark, SF)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got.collect()} == want
