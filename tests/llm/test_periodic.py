"""Runs of periodic words against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hirescope.llm import periodic, queries
from llm_cases import EDGES, docs  # noqa: F401

SF = "/root/testdata/sf0.001"


def plain_runs(w, min_words=24, periods=3):
    """Runs by trying every period at every place."""
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(min_words, periods * q) and not any(w[s : e - r] == w[s + r : e] for r in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_words(rng, n):
    kind = rng.random()
    if kind < 0.3:
        return [rng.randint(0, 1) for _ in range(n)]
    if kind < 0.6:
        w = []
        while len(w) < n:
            w += [rng.randint(0, 3) for _ in range(rng.randint(1, 40))] * rng.randint(1, 6)
            if rng.random() < 0.3:
                w += w[-rng.randint(1, len(w)):]
        return w[:n]
    return (([rng.randint(0, 2) for _ in range(rng.randint(1, 9))] * rng.randint(1, 8) + [rng.randint(0, 2)]) * 12)[:n]


@pytest.mark.parametrize("n", [2, 32, 64, 128, 4096, 8192])
def test_transform_and_back(n):
    x = np.random.default_rng(n).integers(0, periodic.PRIME, (3, n)).astype(float)
    y = periodic.transform(periodic.transform(x), inverse=True)
    assert (periodic._reduced(y * pow(n, -1, periodic.PRIME)) == x).all()
    if n <= 128:
        root = pow(periodic.GENERATOR, (periodic.PRIME - 1) // n, periodic.PRIME)
        assert periodic.transform(x)[1].tolist() == [
            sum(int(v) * pow(root, i * k, periodic.PRIME) for i, v in enumerate(x[1])) % periodic.PRIME for k in range(n)]


@pytest.mark.parametrize(("size", "width"), [(8, 22), (16, 31), (64, 127), (1024, 2047)])
def test_sums_are_exact(size, width):
    rng = np.random.default_rng(size)
    most = int(((periodic.PRIME - 1) / size) ** 0.5)
    blocks, windows = rng.integers(0, most + 1, (4, size)), rng.integers(0, most + 1, (4, width))
    windows[2, 3 : 3 + size] = blocks[2]
    blocks[3], windows[3] = 0, most  # the greatest sum there is
    want = [[int(((b - w[p : p + size]) ** 2).sum()) for p in range(width - size + 1)] for b, w in zip(blocks, windows)]
    assert periodic.mismatches(blocks, windows).tolist() == want


@pytest.mark.parametrize("longest", [8, 16, 1 << 18])
def test_runs_are_those_of_brute_force(longest):
    rng = random.Random(longest)
    for _ in range(400):
        w = odd_words(rng, rng.randint(0, 170))
        assert periodic.find_runs(np.array(w, np.int64), longest=longest) == plain_runs(w)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 30), st.integers(3, 6))
def test_runs_in_other_words(around, period, times):
    w = around + list(range(10, 10 + period)) * times + around
    assert periodic.find_runs(np.array(w, np.int64)) == plain_runs(w)


def test_words_that_fold_alike_are_told_apart(monkeypatch):
    """With two symbols nearly all blocks seem to match; the extension over the words decides."""
    rng = random.Random(3)
    monkeypatch.setattr(periodic, "_next_distance", lambda words: np.zeros(len(words), np.int64))
    for _ in range(30):
        w = odd_words(rng, 150)
        w = [x * 7919 for x in w]
        assert periodic.find_runs(np.array(w, np.int64)) == plain_runs(w)


def test_hard_texts_take_no_long_time():
    """Doubling a text takes about twice the time, whatever repeats in it."""
    from time import thread_time

    rng = np.random.default_rng(0)
    kinds = [lambda n: np.zeros(n, np.int64), lambda n: np.arange(n) % 17, lambda n: rng.integers(0, 2, n),
             lambda n: np.tile(rng.integers(0, 9000, n // 4), 4)]
    for kind in kinds:
        seconds = []
        for n in (40_000, 80_000):
            w = kind(n)
            begin = thread_time()
            periodic.find_runs(w)
            seconds.append(thread_time() - begin)
        assert seconds[1] < 4 * seconds[0] + 0.3


def test_shorter_runs_are_refused():
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(50, np.int64), min_words=10)


def test_greatest_run():
    assert periodic.greatest([]) is None
    assert periodic.greatest([(5, 30, 10), (7, 33, 11), (7, 36, 12)]) == (5, 30, 10)
    assert periodic.greatest([(0, 10**9 * 3 + 1, 10**9), (1, 31, 10)]) == (1, 31, 10)


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_query_equals_brute_force(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r["text"] or "") < 9000]
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    want = {r["doc_id"]: plain_row(r["doc_id"], r["text"]) for r in rows}
    assert {k: got[k] for k in want} == want and sum(w[1] > 0 for w in want.values()) > 5


def test_edge_cases(spark, docs):  # noqa: F811
    tail = next(i for i in range(100, 1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [*[r for r in EDGES if r[0] != 6], (tail, None), (tail, "a"), (tail, "x y é z\x0b" * 30), (60, "w " * 400), (61, ("a b " * 20 + "c ") * 4)]
    table = docs(*rows).withColumnsRenamed({"lang": "runs", "source": "collapsed"})
    got = sorted((tuple(r) for r in periodic.digest(periodic.with_repeated_tails(table)).collect()), key=str)
    assert got == sorted((plain_row(r[0], r[1]) if r[0] is not None else (None, *plain_row(1, r[1])[1:]) for r in rows), key=str)
    whole = periodic.collapse(table).where("doc_id = 61").first()
    assert [tuple(r) for r in whole["runs"]] == plain_runs((("a b " * 20 + "c ") * 4).split()) and whole["collapsed"].startswith("a b c")
    assert periodic.digest(table.where("false")).collect() == []


def test_long_text(spark, docs):  # noqa: F811
    text = " ".join(f"w{i % 30_011}" for i in range(120_000))
    got = periodic.collapse(docs((1, text))).first()
    assert [tuple(r) for r in got["runs"]] == [(0, 120_000, 30_011)]
    assert got["collapsed"] == " ".join(f"w{i}" for i in range(30_011))
