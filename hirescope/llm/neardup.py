"""Jaccard join of documents on word 5-grams by the chosen path, with classes and link counts.

Every document becomes its set of hashed 5-grams (lower-cased words; a shorter
text is one gram of all its words). Documents with equal sets form a copy class
and one of them stands for it. Representatives carry ``COORDINATES`` minima of
independent hash orders; such a minimum is a sampled token, and two sets share it
with a probability equal to their similarity. In each of ``RUNS`` runs a set
follows paths: at a node one coordinate, and with probability 1/4 (by the node's
hash) a second one, is taken, and the node's sets are split by their values there.
Nodes of up to ``LEAF`` sets are leaves, larger ones are split again, up to
``DEPTH`` times. Every run and place in it has orders of its own, so ``separated``
to the power of ``RUNS`` is the probability that all runs separate a pair whose
nodes are all split; there are as many runs as pairs of ``SIMILARITY`` need for
``RECALL``: eight, which miss 0.00094 at 0.8 and 0.0000057 at 0.9.

At a leaf all pairs are compared by their whole sets, so every reported link is
exact. Leaves with equal members are compared once, and a pair that meets in
several leaves counts in the first only. A leaf that stays large (many near
copies) is cut into blocks that are compared pair by pair of blocks, in different
tasks, and gives one row per member and block, never a row per pair. Links join
each set with the least one it is connected to inside a block; connected
components over those stars are found by alternating star steps.

Cases: null, empty and blank texts have no grams and no links; repeated rows are
copies; ties go to the earliest row; an empty table gives no rows; texts of any
length are taken whole.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirescope.llm.common import byte_texts, prepare
from hirescope.functions.graph import components
from hirescope.session import materialize

WORDS = 5
SIMILARITY = 0.8
#: Of the pairs at exactly ``SIMILARITY`` whose nodes are large at every step, the share that must meet.
RECALL = 0.999
DEPTH = 3
LEAF = 64
BLOCK = 256
WORD_MEMORY = 200_000
_GRAM_BYTES = 6


def separated(similarity: float, depth: int = DEPTH) -> float:
    """Probability that one run separates a pair in nodes that are split ``depth`` times."""
    meets = 1.0
    for _ in range(depth - 1):
        step = similarity * meets
        meets = 0.75 * step + 0.25 * (1 - (1 - step) ** 2)
    return 1 - similarity * meets


RUNS = math.ceil(math.log(1 - RECALL) / math.log(separated(SIMILARITY)))
#: A root and two children to each place of a run but the last ones.
PLACES = (1 << DEPTH) - 1
COORDINATES = RUNS * PLACES
_MINIMA = [f"m{i}" for i in range(COORDINATES)]
_FACTORS = np.array([xxhash.xxh3_64_intdigest(b"order", seed=i) | 1 for i in range(COORDINATES)], np.uint64)


@functools.cache
def _word_memory() -> dict[bytes, int]:
    return {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(raw: bytes) -> np.ndarray:
    """The sorted set of 48-bit hashes of 5-grams of a text."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    memory = _word_memory()
    if len(memory) > WORD_MEMORY:
        memory.clear()
    for w in words:
        if w not in memory:
            memory[w] = xxhash.xxh3_64_intdigest(w)
    h = np.array([memory[w] for w in words], np.uint64)
    n = min(WORDS, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return np.unique(_mixed(out) >> np.uint64(64 - 8 * _GRAM_BYTES))


def packed(grams_: np.ndarray) -> bytes:
    return np.ascontiguousarray(grams_.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_GRAM_BYTES]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    small = np.frombuffer(raw, np.uint8).reshape(-1, _GRAM_BYTES)
    out = np.zeros((len(small), 8), np.uint8)
    out[:, :_GRAM_BYTES] = small
    return out.view("<u8").ravel()


_SETS = "row long, doc_id long, tag long, hash long, n long, c0 long, c1 long, " + ", ".join(f"{m} int" for m in _MINIMA)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        minima = np.zeros((rows, COORDINATES), np.uint64)
        head = np.zeros((rows, 3), np.int64)
        for i, raw in enumerate(byte_texts(batch.column(4))):
            g = grams(raw)
            if len(g):
                a = _mixed(g)
                head[i] = len(g), a.sum(dtype=np.uint64).astype(np.int64), _mixed(a + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)
                for k in range(COORDINATES):
                    minima[i, k] = (a * _FACTORS[k]).min()
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], *[pa.array(head[:, k]) for k in range(3)],
             *[pa.array(minima[:, k].astype(np.uint32).view(np.int32)) for k in range(COORDINATES)]],
            names=["row", "doc_id", "tag", "hash", "n", "c0", "c1", *_MINIMA])


def document_sets(docs: DataFrame, id_col: str, text_col: str, tag: str | None) -> DataFrame:
    prepare(docs.sparkSession)
    tagged = (F.col(tag) if tag else F.lit(None)).cast("long").alias("tag")
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), tagged,
                                   F.xxhash64(F.col(text_col).cast("string")).alias("hash"), F.col(text_col).cast("string").alias("text")).mapInArrow(_sets, _SETS), "gram-sets")


def _children(rows: DataFrame) -> DataFrame:
    """Paths one step on: (rep, path, place) and the minima -> (rep, path, place) by the coordinates of the places."""
    run, at = F.floor(F.col("place") / PLACES), F.pmod("place", F.lit(PLACES))
    first = (run * PLACES + 2 * at + 1).cast("int")
    two = F.pmod(F.xxhash64("path", F.lit(0)), F.lit(4)) == 0
    picks = F.when(two, F.array(first, first + 1)).otherwise(F.array(first))
    return (rows.select("rep", "path", F.array(*_MINIMA).alias("_m"), F.explode(picks).alias("place"))
            .select("rep", F.xxhash64("path", "place", F.element_at("_m", F.col("place") + 1)).alias("path"), "place"))


def leaves(reps: DataFrame) -> DataFrame:
    """(rep, path, n): in which leaves a representative must be compared, and how many are there."""
    slim = reps.select("rep", *_MINIMA)
    # A coordinate is a place of a run; the root of run r is place r * PLACES.
    roots = F.array(*[F.struct(F.xxhash64(F.lit(r), _MINIMA[r * PLACES]).alias("path"), F.lit(r * PLACES).alias("place"))
                      for r in range(RUNS)])
    rows = slim.select("rep", F.explode(roots).alias("_r")).select("rep", "_r.path", "_r.place")
    found = None
    for level in range(DEPTH):
        sizes = rows.groupBy("path").agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x0"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x1"))
        # Written, so that both sides of the join are plain exchanges and Spark can split a node that
        # very many sets reach (those that share a very common passage).
        met = materialize(rows.join(materialize(sizes.where("n > 1"), "path-sizes"), "path"), "paths")
        done = met if level == DEPTH - 1 else met.where(F.col("n") <= LEAF)
        found = done if found is None else found.unionByName(done)
        if level < DEPTH - 1:
            rows = _children(met.where(F.col("n") > LEAF).select("rep", "path", "place").join(slim, "rep"))
    # Of leaves with the same members one is compared.
    first = found.groupBy("n", "x0", "x1").agg(F.min("path").alias("path")).select("path")
    return found.select("rep", "path", "n").distinct().join(first, "path", "left_semi")


def compare(sets: list[np.ndarray], earlier: list[list[int]], copies: np.ndarray,
            side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Copies linked to each member by pairs that meet here first, and the least member it is connected to.

    ``side`` is 0 or 1 by block where two blocks meet (then only pairs across count).
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    shared = _common(sets)
    linked = shared * (1 + SIMILARITY) >= SIMILARITY * (sizes[:, None] + sizes[None, :]) - 1e-6
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    before = _common([np.array(e, np.int64) for e in earlier]) if any(earlier) else np.zeros((n, n))
    count = (linked & (before == 0)) @ copies.astype(np.float64)
    root = np.arange(n)
    for i in range(n):
        near = np.flatnonzero(linked[i, :i])
        if len(near):
            merged = np.unique(root[np.append(near, i)])
            root[np.isin(root, merged)] = merged[0]
    return count.astype(np.int64), np.where(linked.any(1), root, -1)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, through the elements that at least two sets hold."""
    n = len(sets)
    if n == 2:
        both = float(len(np.intersect1d(sets[0], sets[1], assume_unique=True)))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    times = np.bincount(column, minlength=len(values))
    out = np.zeros((n, n))
    everywhere = times == n
    out += everywhere.sum()
    kept = (times > 1) & ~everywhere
    place = np.cumsum(kept) - 1
    here = kept[column]
    column, owner = place[column[here]], owner[here]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = max(1, (1 << 22) // n)
    for start in range(0, int(kept.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        dense = np.zeros((n, width), np.float32)
        dense[owner[a:b], column[a:b] - start] = 1
        out += dense @ dense.T
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (path, bi, bj) and rep -> rep, links, hub. One group is in memory at a time."""
    group: list[dict] = []
    key = None
    out: list[tuple[int, int, int]] = []

    def close() -> None:
        if len(group) < 2:
            return
        side = None if key[1] == key[2] else np.array([r["own"] == key[1] for r in group], np.int8)
        if side is not None and side.min() == side.max():
            return
        count, root = compare([unpacked(r["sh"]) for r in group],
                              [[p for p in r["all"] if p < key[0]] for r in group], np.array([r["copies"] for r in group]), side)
        out.extend((r["rep"], int(c), group[k]["rep"]) for r, c, k in zip(group, count, root) if k >= 0)

    def flushed() -> pa.RecordBatch:
        cols = list(zip(*out)) or [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["rep", "links", "hub"])

    for batch in batches:
        for r in batch.to_pylist():
            own_key = (r["path"], r["bi"], r["bj"])
            if own_key != key:
                close()
                group, key = [], own_key
            if not group or group[-1]["rep"] != r["rep"]:
                group.append(r)
        yield flushed()
    close()
    yield flushed()


def _with_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([packed(grams(raw)) for raw in byte_texts(batch.column(3))], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], sets], names=["rep", "copies", "leaves", "sh"])


def links(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, links, hub): linked copies by block, and the least set it is connected to there.

    ``texts`` (doc_id, hash, text) is read once more for the sets of those that share a leaf, so that
    sets of all documents need not be kept. A text that is there twice is compared once.
    """
    found = materialize(leaves(reps), "leaves")
    of_rep = found.groupBy("rep").agg(F.collect_list(F.struct("path", "n")).alias("leaves"))
    sought = of_rep.join(reps.select("rep", "copies", "rep_doc", "rep_hash"), "rep").select(
        "rep", "copies", "leaves", F.coalesce("rep_doc", F.lit(0)).alias("_id"), F.col("rep_hash").alias("hash"))
    held = (texts.withColumn("_id", F.coalesce("doc_id", F.lit(0))).join(sought, ["_id", "hash"])
            .select("rep", "copies", "leaves", "text")
            .mapInArrow(_with_grams, "rep long, copies long, leaves array<struct<path: long, n: long>>, sh binary"))
    held = held.select("rep", "sh", "copies", F.col("leaves.path").alias("all"), F.explode("leaves").alias("_leaf")).select(
        "rep", "sh", "copies", "all", F.col("_leaf.path").alias("path"), F.col("_leaf.n").alias("n"))
    blocks = F.when(F.col("n") <= LEAF, 1).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int")
    held = held.withColumn("own", F.pmod(F.xxhash64("rep", "path"), blocks).cast("int")).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    key = ["path", "bi", "bj"]
    held = held.select("path", F.least("own", "_other").alias("bi"), F.greatest("own", "_other").alias("bj"), "own",
                       "rep", "copies", "all", "sh")
    return materialize(held.repartition(*key).sortWithinPartitions(*key, "rep")
                       .mapInArrow(_links, "rep long, links long, hub long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: str | None = None) -> DataFrame:
    """Per row of ``docs``: row (its number), doc_id, tag, class_row and class_id (the earliest row of its class, and that
    row's id), copy_id (the earliest row's id with an equal set) and n_links (other rows of similarity
    ``SIMILARITY`` or more). ``tag`` names a column of numbers to hand through."""
    sets = document_sets(docs, id_col, text_col, tag)
    words = sets.where("n > 0")
    reps = materialize(
        words.groupBy("n", "c0", "c1").agg(F.min("row").alias("rep"), F.min_by("doc_id", "row").alias("rep_doc"),
                                           F.min_by("hash", "row").alias("rep_hash"),
                                           F.count("*").alias("copies"), *[F.min(m).alias(m) for m in _MINIMA]), "reps")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = links(texts.withColumn("hash", F.xxhash64("text")), reps)
    joined = components(found.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct())
    count = found.groupBy("rep").agg(F.sum("links").alias("_links"))
    named = joined.select(F.col("a").alias("rep"), F.col("b").alias("class_row")).join(
        reps.select(F.col("rep").alias("class_row"), F.col("rep_doc").alias("class_id")), "class_row")
    known = materialize(
        reps.select("n", "c0", "c1", "rep", "rep_doc", "copies").join(count, "rep", "left").join(named, "rep", "left").select(
            "n", "c0", "c1", F.col("rep_doc").alias("copy_id"), F.coalesce("class_row", "rep").alias("class_row"),
            F.when(F.col("class_row").isNull(), F.col("rep_doc")).otherwise(F.col("class_id")).alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links")), "classes")
    return sets.select("row", "doc_id", "tag", "n", "c0", "c1").join(known, ["n", "c0", "c1"], "left").select(
        "row", "doc_id", "tag", F.coalesce("class_row", "row").alias("class_row"),
        F.when(F.col("class_row").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("class_row").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
