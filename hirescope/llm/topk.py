"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into 1, 4, 16, 32 and 48 segments. With mean m and deviation s of each
segment of length n, <u, v> <= sum of n (m_u m_v + s_u s_v) (Cauchy-Schwarz on
what is left after the means); equally |u|^2 + |v|^2 - 2 <u, v> is bounded from
below. So the bound of a level is an inner product of short feature vectors. From
coarse to fine, candidates whose bound is below the k-th exact score among those of the highest bounds
are dropped, and exact scores are computed for the survivors only. Vectors whose
energy lies in few segments leave at the coarse levels; directions without any
structure need the fine ones (:func:`survivors` tells the shares).

Queries and candidates are gathered in blocks of bounded size; each block of
candidates meets each block of queries in one task and returns k rows per query,
which are then ranked per query. Nothing grows with the table but the number of
blocks.

Cases: vectors that are null or hold null or non-finite components take no part,
nor do rows without an id; vectors of different length are not compared; a zero
vector is a vector; of repeated rows each is a query or candidate of its own, a
row never its own candidate; ties go to the smaller vec_id; fewer than k
candidates give fewer rows. Scores outside 64 bits are held at their limits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirescope.llm.common import prepare
from hirescope.session import materialize

LEVELS = (1, 4, 16, 32, 48)
CANDIDATE_BLOCK = 16_384
QUERY_BLOCK = 1_024
SCALE = 64
_CHUNK = 128


def quantised(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """row_no, vec_id, dim and the vector of floor(SCALE * x) as packed doubles."""
    prepare(rows.sparkSession)
    slim = rows.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).cast("long").alias("vec_id"),
                       F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            values = column.flatten()
            flat = np.floor(SCALE * values.to_numpy(zero_copy_only=False).astype(np.float64))
            sizes = np.array(column.value_lengths().to_pylist(), np.int64)
            ends = np.cumsum(sizes)
            fine = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            ok = (fine[ends] == fine[ends - sizes]) & (sizes > 0)
            packed = [flat[e - n : e].tobytes() for e, n, k in zip(ends, sizes, ok) if k]
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(sizes[ok], pa.int64()), pa.array(packed, pa.binary())],
                names=["row_no", "vec_id", "dim", "vector"])

    return slim.mapInArrow(run, "row_no long, vec_id long, dim long, vector binary")


def _blocks(rows: DataFrame, sizes: dict[int, int], block: int, name: str) -> DataFrame:
    """Rows of one block as one row of packed arrays."""
    counts = F.create_map(*[F.lit(x) for dim, n in sizes.items() for x in (dim, math.ceil(n / block))])
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("row_no"), F.element_at(counts, F.col("dim"))))

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [part["dim"].iloc[0]], name: [part[name].iloc[0]],
                             "rows": [part["row_no"].to_numpy().tobytes()], "ids": [part["vec_id"].to_numpy().tobytes()],
                             "vectors": [b"".join(part["vector"])]})

    return dealt.groupBy("dim", name).applyInPandas(gather, f"dim long, {name} long, rows binary, ids binary, vectors binary")


def features(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of segments, scaled so that their inner product bounds that of the vectors."""
    dim = vectors.shape[1]
    starts = np.unique(np.arange(min(segments, dim)) * dim // min(segments, dim))
    n = np.diff(np.append(starts, dim))
    mean = np.add.reduceat(vectors, starts, axis=1) / n
    centred = vectors - np.repeat(mean, n, axis=1)
    deviation = np.sqrt(np.add.reduceat(centred * centred, starts, axis=1))
    return np.hstack([mean * np.sqrt(n), deviation])


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of ``a`` with columns of ``b``, as float64 where that is exact, else int64."""
    if len(a) == 0 or b.shape[1] == 0 or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return a @ b
    got = np.vectorize(int, otypes=[object])(a) @ np.vectorize(int, otypes=[object])(b)
    return np.clip(got, -(2**63), 2**63 - 1).astype(np.int64)


def best(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray,
         k: int, left: list[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its place, the places of its k best candidates of the block, and their scores.

    ``left`` gets the number of pairs before the first level and those left after each, added up.
    """
    left = [0] * (len(LEVELS) + 1) if left is None else left
    levels = [features(vectors, s).T for s in LEVELS]
    for first in range(0, len(queries), _CHUNK):
        q = queries[first : first + _CHUNK]
        own = query_rows[first : first + _CHUNK, None] == rows[None, :]
        least = np.full(len(q), -np.inf)
        alive = ~own
        left[0] += int(alive.sum())
        for nth, (segments, level) in enumerate(zip(LEVELS, levels), 1):
            bound = features(q, segments) @ level
            bound += 1e-6 * (1 + np.abs(bound))  # rounding never drops a candidate
            bound[~alive] = -np.inf
            if len(rows) > k:
                # The k-th exact score among the candidates of the highest bounds is a score to reach.
                some = min(4 * k, len(rows) - 1)
                top = np.argpartition(-bound, some, axis=1)[:, :some]
                for i, places in enumerate(top):
                    places = places[alive[i, places]]
                    if len(places) >= k:
                        known = _exact(q[i : i + 1], vectors[places].T)[0]
                        least[i] = max(least[i], float(np.partition(known, len(known) - k)[len(known) - k]))
            alive &= bound >= least[:, None]
            left[nth] += int(alive.sum())
        for i in range(len(q)):
            places = np.flatnonzero(alive[i])
            score = _exact(q[i : i + 1], vectors[places].T)[0]
            if len(places) > k:
                keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                places, score = places[keep], score[keep]
            order = np.lexsort((rows[places], ids[places], -score))[:k]
            yield first + i, places[order], score[order]


def survivors(queries: np.ndarray, vectors: np.ndarray, k: int = 20) -> list[float]:
    """Share of the pairs of some queries and candidates that is left after each level."""
    left = [0] * (len(LEVELS) + 1)
    nobody, rows = np.full(len(queries), -1), np.arange(len(vectors))
    for _ in best(queries, nobody, vectors, rows, rows, k, left):
        pass
    return [n / max(left[0], 1) for n in left[1:]]


def search(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each row for which ``is_query`` (a
    condition on vec_id) holds, against all other rows."""
    vectors = materialize(quantised(rows, id_col, vec_col), "vectors")
    chosen = vectors.where(is_query)
    # One row per length of vector.
    total = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    asked = {r["dim"]: r["n"] for r in chosen.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not asked:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id",
                              F.lit(0).cast("long").alias("score")).where("false")
    candidates = _blocks(vectors, total, CANDIDATE_BLOCK, "block")
    queries = _blocks(chosen, asked, QUERY_BLOCK, "q_block").select(
        "dim", F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    last = F.create_map(*[F.lit(x) for dim, n in total.items() for x in (dim, math.ceil(n / CANDIDATE_BLOCK) - 1)])
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.element_at(last, F.col("dim")).cast("long"))))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q_ids, q_rows = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.q_rows, np.int64)
                ids, row_no = np.frombuffer(r.ids, np.int64), np.frombuffer(r.rows, np.int64)
                q = np.frombuffer(r.q_vectors, np.float64).reshape(len(q_ids), -1)
                v = np.frombuffer(r.vectors, np.float64).reshape(len(ids), -1)
                found = list(best(q, q_rows, v, row_no, ids, k))
                n = [len(p) for _, p, _ in found]
                at = np.concatenate([p for _, p, _ in found])
                who = np.repeat([i for i, _, _ in found], n)
                yield pd.DataFrame({"q_row": q_rows[who], "query_id": q_ids[who], "row_no": row_no[at], "vec_id": ids[at],
                                    "score": np.concatenate([s for _, _, s in found]).astype(np.int64)})

    met = queries.join(candidates, ["dim", "block"]).mapInPandas(
        compare, "q_row long, query_id long, row_no long, vec_id long, score long")
    order = Window.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id", "row_no")
    return (met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
