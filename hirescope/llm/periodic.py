"""Runs of periodic words by block convolution.

A run is a stretch of consecutive words with smallest period q, at least
``MIN_WORDS`` words and ``MIN_PERIODS`` periods long, that no neighbouring word
extends. At each dyadic scale B a text is cut into blocks of B words. A run whose
period is between B and 2 B (at the first scale: under 2 B) holds a whole block
and its next occurrence, so it is enough to know at which of these distances each block
occurs again without a mismatch. That is where the sum of squared differences of
block and window is zero; it is taken for all distances at once by an exact integer
number-theoretic transform: words are folded into so few symbols that no
sum reaches the prime, so a sum is zero only if all symbols agree. Every distance
found seeds an extension over the words themselves, to both sides, which tells the run's
borders and puts right what folding made equal.

Blocks are left out only where nothing can be found: where a word of the block does not
come again within the window, or where the window lies in a known run of a period of at most B
(then all distances are multiples of that period). Distances of a block and its
copy inside one known run, and multiples of its period, give that run again and seed nothing.

The transform multiplies by exact matrices of at most 64 roots, for many blocks at
a time; blocks longer than ``LONGEST`` words are not formed: such periods are
sought by blocks of that length in windows further on.

Cases: a null text has no words; repeated rows give repeated results; an empty
table gives no rows; ties of the greatest exponent go to the smallest start, then period;
texts of any length are taken whole.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirescope.llm.common import byte_texts, prepare

MIN_WORDS = 24
MIN_PERIODS = 3
#: The first scale: a run of MIN_WORDS words with a shorter period holds such a block and its copy.
FIRST = 8
LONGEST = 1 << 18
#: A prime with roots of unity of order 2^20: 7 * 2^20 + 1, and a generator of its units.
PRIME, GENERATOR = 7340033, 3
#: Words of the windows that are transformed at once.
AT_ONCE = 1 << 19
_RADIX = 64

Run = tuple[int, int, int]  # start, length, period


def _reduced(x: np.ndarray) -> np.ndarray:
    """Exact integers under 2^53 modulo the prime."""
    x = x - np.floor(x * (1.0 / PRIME)) * PRIME
    x += PRIME * (x < 0)
    x -= PRIME * (x >= PRIME)
    return x


def _powers(root: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    done = 1
    while done < n:
        step = pow(root, done, PRIME)
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step % PRIME
        done += more
    return out


@functools.lru_cache(maxsize=64)
def _roots(n: int, inverse: bool) -> np.ndarray:
    """Powers of the root of unity of order ``n``."""
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    return _powers(pow(root, -1, PRIME) if inverse else root, n)


@functools.lru_cache(maxsize=16)
def _matrix(n: int, inverse: bool) -> np.ndarray:
    place = np.arange(n)
    return _roots(n, inverse)[np.outer(place, place) % n].astype(np.float64)


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two of residues, as exact floats), not scaled.

    A product of at most 64 residues by 64 roots stays under 2^53.
    """
    rows, n = x.shape
    if n <= _RADIX:
        return _reduced(x @ _matrix(n, inverse))
    inner = n // _RADIX
    # Over the outer digit of the place first, then the twiddle factors, then over the inner digit.
    y = _reduced(_matrix(_RADIX, inverse) @ x.reshape(rows, _RADIX, inner))
    twiddle = _roots(n, inverse)[np.outer(np.arange(_RADIX), np.arange(inner))].astype(np.float64)
    y = _reduced(y * twiddle)
    z = transform(y.reshape(rows * _RADIX, inner), inverse).reshape(rows, _RADIX, inner)
    return z.transpose(0, 2, 1).reshape(rows, n)


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences of each block (B symbols) with its window from places 0 to W - B.

    Symbols are whole numbers; every sum must be under the prime, and is exact then.
    """
    rows, size = blocks.shape
    width = windows.shape[1]
    n = 1 << (width - 1).bit_length()
    a, b = np.zeros((rows, n)), np.zeros((rows, n))
    a[:, :size][:, ::-1] = blocks
    b[:, :width] = windows
    product = transform(_reduced(transform(a) * transform(b)), inverse=True)
    # The inverse of n modulo the prime brings the convolution to scale.
    cross = _reduced(product * pow(n, -1, PRIME))[:, size - 1 : width]
    squares = np.concatenate([np.zeros((rows, 1)), np.cumsum(windows.astype(np.float64) ** 2, axis=1)], axis=1)
    own = (blocks.astype(np.float64) ** 2).sum(1, keepdims=True)
    return _reduced(_reduced(own + squares[:, size:] - squares[:, :-size]) + 2 * (PRIME - cross))


def _next_distance(words: np.ndarray) -> np.ndarray:
    """Distance from each word to the next equal one; more than the text where there is none."""
    n = len(words)
    out = np.full(n, 2 * n + 1, np.int64)
    order = np.argsort(words, kind="stable")
    same = words[order][1:] == words[order][:-1]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _extended(words: np.ndarray, at: int, end: int, d: int) -> tuple[int, int] | None:
    """The maximal stretch (start, end) of period ``d`` around words [at, end) and their copies; None if they differ."""
    n = len(words)
    if not np.array_equal(words[at:end], words[at + d : end + d]):
        return None
    step = 64
    while end + d < n:
        stop = min(n - d, end + step)
        differ = np.flatnonzero(words[end:stop] != words[end + d : stop + d])
        if len(differ):
            end += int(differ[0])
            break
        end, step = stop, step * 2
    step = 64
    while at > 0:
        stop = max(0, at - step)
        differ = np.flatnonzero(words[stop:at] != words[stop + d : at + d])
        if len(differ):
            at = stop + int(differ[-1]) + 1
            break
        at, step = stop, step * 2
    return at, end + d


def _seeds(words: np.ndarray, nearest: np.ndarray, size: int, lowest: int, known: list[Run]) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of all occurrences of blocks of ``size`` words ``lowest`` to ``lowest`` + ``size`` - 1 words on
    (at the first scale: 1 to 2 ``size`` - 1)."""
    n = len(words)
    first = 1 if size == FIRST and lowest == FIRST else lowest
    highest = lowest + size - 1
    count = n // size
    starts = np.arange(count) * size
    may = (nearest[: count * size].reshape(count, size).max(1) <= highest) & (starts + size + first <= n)
    for start, length, period in known:
        if period <= size:
            may &= ~((starts >= start) & (starts + size + highest <= start + length))
    starts = starts[may]
    # Folded so far that size * (symbols - 1)^2 is under the prime.
    symbols = int(((PRIME - 1) / size) ** 0.5) + 1
    folded = ((words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(symbols)
    width = size + highest - first
    padded = np.concatenate([folded.astype(np.int64), np.zeros(width + highest, np.int64)])
    found = [], []
    rows = max(1, AT_ONCE // width)
    for i in range(0, len(starts), rows):
        some = starts[i : i + rows]
        sums = mismatches(padded[some[:, None] + np.arange(size)], padded[some[:, None] + first + np.arange(width)])
        row, place = np.nonzero(sums == 0)
        inside = some[row] + first + place + size <= n
        found[0].append(some[row[inside]])
        found[1].append(first + place[inside])
    return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)


def find_runs(words: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, longest: int = LONGEST) -> list[Run]:
    """All runs (start, length, smallest period) of a sequence of whole numbers, by start, then period.

    ``min_words`` is at least 24 and ``min_periods`` at least 3: shorter runs need not hold a block.
    """
    if min_words < MIN_WORDS or min_periods < MIN_PERIODS:
        raise ValueError(f"runs have at least {MIN_WORDS} words and {MIN_PERIODS} periods")
    n = len(words)
    runs: list[Run] = []
    if n < min_words:
        return runs
    nearest = _next_distance(words)
    size = lowest = FIRST
    while lowest == FIRST or min_periods * lowest <= n:
        at, d = _seeds(words, nearest, size, lowest, runs)
        # By distance, so that a stretch meets its smallest period first.
        order = np.lexsort((at, d))
        at, d = at[order], d[order]
        open_ = np.ones(len(at), bool)
        for start, length, period in runs:
            open_ &= ~((at >= start) & (at + size + d <= start + length) & (d % period == 0))
        while open_.any():
            i = int(open_.argmax())
            block, period = int(at[i]), int(d[i])
            stretch = _extended(words, block, block + size, period)
            open_[i] = False
            if stretch is None:
                continue
            start, end = stretch
            inside = (at >= start) & (at + size + d <= end)
            if end - start >= max(min_words, min_periods * period):
                runs.append((start, end - start, period))
                open_ &= ~(inside & (d % period == 0))
            else:
                open_ &= ~(inside & (d == period))
        lowest += size
        if size < longest:
            size *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def word_numbers(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which words stay: in a run those of its first period."""
    kept = np.ones(n, bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return kept


def greatest(runs: list[Run]) -> Run | None:
    """The run of the greatest length by period; of equal ones the first, of these the one of the smallest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_ARROW_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def collapse(docs: DataFrame, text_col: str = "text", out: tuple[str, str] = ("runs", "collapsed")) -> DataFrame:
    """``docs`` with the runs of each text (array of start, length, period, by start, then period) and its
    words without repetitions, joined by single blanks; ``out`` replace columns of the same names."""
    prepare(docs.sparkSession)
    docs = docs.drop(*out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out[0], T.ArrayType(_RUN)), T.StructField(out[1], T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed, kept = [], []
            for raw in byte_texts(batch.column(batch.schema.get_field_index(text_col))):
                words = raw.split()
                runs = find_runs(word_numbers(words))
                listed.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                if runs:
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(listed, _ARROW_RUNS), pa.array(kept, pa.string())],
                                             names=[*batch.schema.names, *out])

    return docs.mapInArrow(run, schema)


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes] | None:
    """The words of a document of every tenth id by hash, repeated from some word on; None for other documents."""
    if doc_id is None or not words:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: texts of every tenth document by hash of its id end in repetitions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for doc_id, text, raw in zip(batch.column(0).to_pylist(), batch.column(1), byte_texts(batch.column(1))):
                tail = repeated_tail(doc_id, raw.split())
                texts.append(text.as_py() if tail is None else b" ".join(tail).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    prepare(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, hashes of all runs and of the collapsed text."""
    found = collapse(docs.select("doc_id", "text"))
    # A struct of these orders runs as ``greatest`` does; length / period is compared exactly over whole numbers.
    better = F.aggregate(
        "runs", F.lit(None).cast(_RUN),
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_best", better).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
