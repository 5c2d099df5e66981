"""Prefix trie of conversations, from sorted sequences and range minima.

A conversation is a sequence of turns; a turn is known by a 128-bit hash of its role
and text. Every distinct sequence of first d turns is a node, and the conversations
that start with it are its members. Sorted by their sequences the members of a node
stand together: it is an interval in which neighbours share at least d turns.

The sequences are sorted over all executors and cut into blocks of about
``BLOCK_BYTES``. A block lists the turns that neighbours share (LCPs) and builds a
sparse table of their range minima. Each candidate prefix (a whole conversation, or
what it shares with the one before) binary-searches its left and its right extent
by that table, independently of all others, which gives its interval without a stack.
Prefixes between a candidate and the longer of its two outer LCPs have that interval too.

All figures of a node are sums over its interval once each block knows its two
neighbouring conversations: members count a child, a leaf or a turn's bytes only where they
differ from the one before (or after) them. So only nodes that reach over the
edge of a block (what its neighbour shares: at most its first and last
conversation's turns) are added up over blocks, by their hash; no node is
gathered, however many conversations share it.

The hash of a node's ends is one of a text, read in order: where blocks split them, they
stream through one task in order of their ids, which holds one id at a time.

Cases: null role or text is empty; turns are ordered by number (null first), then
role and text; repeated rows are repeated turns; rows without a conv_id belong to no
conversation; an empty table has no nodes; conversations of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirescope.llm.common import prepare
from hirescope.session import materialize

BLOCK_BYTES = 16 << 20
_HASH = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
_COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
_NODES = "conv_id long, depth long, parent_conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + (
    ", ends_sha256 string, block int, first int, parent_first int, open boolean, key string, parent_key string")


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text: the turns of each conversation in order."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    said = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return said.where("conv_id IS NOT NULL").select("conv_id", (F.row_number().over(order) - 1).alias("place"), "role", "text")


def crossed(said: DataFrame, every: int = 5, modulus: int = 9) -> DataFrame:
    """Conversation c gets the first h turns of c - c % every in place of its own; h = crc32(c) % modulus.

    A row of place -1 marks each conversation, so that those without turns stay.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus
    own = said.where(F.col("place") >= h)
    # A base has few such turns and ``every`` conversations; those that do not exist have no mark.
    base = said.where((F.col("place") < modulus - 1) & (F.pmod("conv_id", F.lit(every)) == 0))
    last = F.coalesce(F.try_add("conv_id", F.lit(every - 1)), F.lit((1 << 63) - 1))
    lent = base.withColumn("conv_id", F.explode(F.sequence("conv_id", last))).where(F.col("place") < h)
    return own.unionByName(lent).unionByName(marks(said))


def marks(said: DataFrame) -> DataFrame:
    return said.where("place = 0").select("conv_id", F.lit(-1).alias("place"), F.lit("").alias("role"), F.lit("").alias("text"))


def _turn_hash() -> Column:
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))


def sequences(said: DataFrame) -> DataFrame:
    """conv_id, seq (the turns' hashes), sizes (bytes of their texts) of conversations that have a mark."""
    is_turn = F.col("place") >= 0
    rows = said.select("conv_id", "place", F.when(is_turn, _turn_hash()).otherwise("").alias("hash"),
                       F.octet_length("text").cast("long").alias("size"))
    turns = F.sort_array(F.collect_list(F.struct("place", "hash", "size")))
    met = rows.groupBy("conv_id").agg(turns.alias("_turns")).where(F.col("_turns")[0]["place"] < 0)
    return met.select("conv_id", F.unhex(F.array_join(F.transform("_turns", lambda t: t["hash"]), "")).alias("seq"),
                      F.transform(F.filter("_turns", lambda t: t["place"] >= 0), lambda t: t["size"]).alias("sizes"))


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // _HASH
    if a[: n * _HASH] == b[: n * _HASH]:
        return n
    k = 0
    while a[k * _HASH : (k + 1) * _HASH] == b[k * _HASH : (k + 1) * _HASH]:
        k += 1
    return k


class RangeMin:
    """Sparse table of the minima of all stretches whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while len(self.rows[-1]) > 1 << (len(self.rows) - 1):
            row, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(row[:-half], row[half:]))

    def least(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Minima of values[start:end], none of them empty."""
        level = np.frexp(end - start)[1] - 1
        out = np.empty(len(start), self.rows[0].dtype)
        for k in np.unique(level):
            at = level == k
            row = self.rows[k]
            out[at] = np.minimum(row[start[at]], row[end[at] - (1 << k)])
        return out

    def extents(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place around each ``at`` between which no value is under its ``depth``.

        Value j stands between places j and j + 1. Each search is its own.
        """
        left, right = at.copy(), at.copy()
        for k in reversed(range(len(self.rows))):
            row, step = self.rows[k], 1 << k
            if not len(row):
                continue
            fits = (left >= step) & (row[np.clip(left - step, 0, len(row) - 1)] >= depth)
            left[fits] -= step
            fits = (right < len(row)) & (row[np.clip(right, 0, len(row) - 1)] >= depth)
            right[fits] += step
        return left, right


def _prefix_keys(seq: bytes, depth: int) -> list[str]:
    """Hashes of the prefixes of 0 to ``depth`` turns."""
    running, out = hashlib.md5(usedforsecurity=False), []
    for d in range(depth + 1):
        out.append(running.copy().hexdigest())
        running.update(seq[d * _HASH : (d + 1) * _HASH])
    return out


def block_nodes(seqs: list[bytes], ids: np.ndarray, sizes: list[np.ndarray], before: bytes | None, after: bytes | None) -> dict:
    """Columns of the nodes of one block of sorted conversations (see ``_NODES``, without block).

    ``before`` and ``after`` are the sequences next to the block. Figures of nodes that reach over its
    edge are the block's share of them.
    """
    m = len(seqs)
    length = np.array([len(s) // _HASH for s in seqs], np.int64)
    inner = np.array([shared_turns(a, b) for a, b in zip(seqs, seqs[1:])], np.int64)
    edge = [-1 if s is None else shared_turns(s, t) for s, t in ((before, seqs[0]), (after, seqs[-1]))]
    lcp = np.concatenate([[edge[0]], inner, [edge[1]]])  # lcp[i] is shared with the one before
    table, least_id = RangeMin(inner), RangeMin(ids)

    # Candidates, their extents, and each interval once.
    at = np.concatenate([np.arange(m), np.arange(1, m)])
    depth = np.concatenate([length, inner])
    left, right = table.extents(at, depth)
    width = int(length.max()) + 2
    _, one = np.unique(left * width + depth, return_index=True)
    left, right, deep = left[one], right[one], depth[one]
    outer = np.maximum(np.where(left > 0, lcp[left], -1), np.where(right < m - 1, lcp[right + 1], -1))

    # One row per depth; the root comes with the least LCP, or with the only conversation.
    times = deep - outer
    l, r, full, low = (np.repeat(x, times) for x in (left, right, deep, outer))
    d = low + 1 + np.arange(len(l)) - np.repeat(np.cumsum(times) - times, times)

    start = np.concatenate([[0], np.cumsum(length + 1)])
    cum = np.concatenate([np.concatenate([[0], np.cumsum(s)]) for s in sizes]).astype(np.int64)
    total = cum[start[1:] - 1]
    new = total - cum[start[:-1] + np.maximum(lcp[:-1], 0)]
    sum_total, sum_new = (np.concatenate([[0], np.cumsum(x)]) for x in (total, new))
    above = np.maximum(d - 1, 0)
    n = r - l + 1
    kept = sum_new[r + 1] - sum_new[l + 1] + total[l] - cum[start[l] + np.maximum(np.maximum(lcp[l], above), 0)]
    saved = sum_total[r + 1] - sum_total[l] - n * cum[start[l] + above] - kept

    # A member starts a child where it shares no more than the node with the one before, and goes on.
    starts = np.arange(1, m)[inner < length[1:]]
    order = np.sort(inner[starts - 1] * (m + 1) + starts)
    children = np.searchsorted(order, full * (m + 1) + r + 1) - np.searchsorted(order, full * (m + 1) + l + 1)
    children = np.where(d < full, 0, children) + ((lcp[l] <= d) & (length[l] > d))
    # A leaf ends with the last of equal members, unless a longer one follows.
    is_leaf = np.concatenate([[0], np.cumsum(lcp[1:] < length)])
    leaves = is_leaf[r + 1] - is_leaf[l]

    # Ends: equal members stand first in the interval of their node.
    fresh = np.concatenate([[True], (inner != length[1:]) | (inner != length[:-1])])
    group = np.flatnonzero(fresh)
    group_end = np.append(group[1:], m)
    split = np.zeros(len(group), bool)
    split[0] |= before is not None and before == seqs[0]
    split[-1] |= after is not None and after == seqs[-1]
    hashes = np.array([None if cut else hashlib.sha256(",".join(map(str, ids[a:b].tolist())).encode()).hexdigest()
                       for a, b, cut in zip(group, group_end, split)], object)
    of_place = np.full(m, -1)
    of_place[group] = np.arange(len(group))
    ended = (length[l] == d) & (of_place[l] >= 0)
    ends = np.where(ended, hashes[np.maximum(of_place[l], 0)], None)

    at_left, at_right = (l == 0) & (edge[0] >= d), (r == m - 1) & (edge[1] >= d)
    open_ = at_left | at_right
    ends = np.where(~ended & ~open_, NO_ENDS, ends)

    # Parents: the same interval, or the one around it a turn earlier.
    pl, pr = l.copy(), r.copy()
    top = (d - 1 == low) & (d > 0)
    pl[top], pr[top] = table.extents(l[top], d[top] - 1)
    parent_open = ((pl == 0) & (edge[0] >= d - 1)) | ((pr == m - 1) & (edge[1] >= d - 1))
    parent = least_id.least(pl, pr + 1)
    firsts, lasts = _prefix_keys(seqs[0], max(edge[0], 0)), _prefix_keys(seqs[-1], max(edge[1], 0))
    key, parent_key = np.full(len(d), None, object), np.full(len(d), None, object)
    for i in np.flatnonzero(open_).tolist():
        keys = firsts if at_left[i] else lasts
        key[i] = keys[d[i]]
        parent_key[i] = keys[d[i] - 1] if d[i] else None
    return {
        "conv_id": pa.array(least_id.least(l, r + 1)), "depth": pa.array(d),
        "parent_conv_id": pa.array(parent, mask=(d == 0) | parent_open | open_),
        "n_convs": pa.array(n), "n_children": pa.array(children), "n_leaves": pa.array(leaves), "saved_tokens": pa.array(saved),
        "ends_sha256": pa.array(ends.tolist(), pa.string()), "first": pa.array(l.astype(np.int32)),
        "parent_first": pa.array(pl.astype(np.int32), mask=~parent_open | (d == 0) | open_),
        "open": pa.array(open_), "key": pa.array(key.tolist(), pa.string()), "parent_key": pa.array(parent_key.tolist(), pa.string()),
    }


_OUT = ("conv_id", "depth", "parent_conv_id", *_COUNTS, "ends_sha256", "block", "first", "parent_first", "open", "key", "parent_key")


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, conv_id, seq, sizes, after) by block; a block's first one (null conv_id) holds its neighbours."""
    block, ids, seqs, sizes, sides = None, [], [], [], (None, None)

    def closed() -> Iterator[pa.RecordBatch]:
        if not seqs:
            return
        cols = block_nodes(seqs, np.array(ids, np.int64), sizes, *sides)
        cols["block"] = pa.array(np.full(len(cols["depth"]), block, np.int32))
        whole = pa.RecordBatch.from_arrays([cols[c] for c in _OUT], names=list(_OUT))
        for at in range(0, whole.num_rows, 1 << 15):
            yield whole.slice(at, 1 << 15)

    for batch in batches:
        sizes_col = batch.column(3)
        for i, (b, conv, seq, after) in enumerate(zip(*[batch.column(k).to_pylist() for k in (0, 1, 2, 4)])):
            if b != block:
                yield from closed()
                block, ids, seqs, sizes, sides = b, [], [], [], (None, None)
            if conv is None:
                sides = (seq, after)
            else:
                ids.append(conv)
                seqs.append(seq)
                sizes.append(np.array(sizes_col[i].as_py(), np.int64))
    yield from closed()


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, conv_id) in order -> key and the hash of its ids joined by commas."""
    key, running = None, None
    for batch in batches:
        done = []
        for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256(str(conv).encode())
            else:
                running.update(b",%d" % conv)
        yield pa.RecordBatch.from_arrays([pa.array([d[j] for d in done], pa.string()) for j in (0, 1)], names=["key", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([running.hexdigest()])], names=["key", "ends"])


def prefix_trie(said: DataFrame, block_bytes: int = BLOCK_BYTES, least_blocks: int | None = None) -> DataFrame:
    """Nodes of the conversations ``said`` (conv_id, place, role, text, with a mark for each): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = prepare(said.sparkSession)
    seqs = materialize(sequences(said), "sequences")
    n_bytes = seqs.agg(F.sum(F.length("seq") + 64)).first()[0] or 0
    least = least_blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(least, math.ceil(n_bytes / block_bytes))
    # By id too, so that blocks split conversations that are all alike.
    ranked = materialize(seqs.repartitionByRange(blocks, "seq", "conv_id").withColumn("block", F.spark_partition_id()), "sorted")
    ends = ranked.groupBy("block").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    along = Window.orderBy("block")  # one row per block
    ends = materialize(ends.select("block", "first", "last", F.lag("last").over(along).alias("before"),
                                   F.lead("first").over(along).alias("after")), "block-ends")
    no = lambda kind: F.lit(None).cast(kind)
    rows = ranked.select("block", "conv_id", "seq", "sizes", no("binary").alias("after")).unionByName(
        ends.select("block", no("long").alias("conv_id"), F.col("before").alias("seq"), no("array<long>").alias("sizes"), "after"))
    rows = rows.repartition(blocks, "block").sortWithinPartitions("block", F.col("conv_id").isNotNull(), "seq", "conv_id")
    parts = materialize(rows.mapInArrow(_nodes, _NODES), "trie-parts")

    # Ends that blocks split.
    cut = ends.where("first = before").select("block", F.col("first").alias("seq")).union(
        ends.where("last = after").select("block", F.col("last").alias("seq"))).distinct()
    streamed = ranked.join(cut, ["block", "seq"]).select(F.md5("seq").alias("key"), "conv_id")
    streamed = streamed.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_end_hashes, "key string, ends string")

    # Nodes over block edges.
    shares = parts.where("open")
    met = shares.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"),
                                    *[F.sum(c).alias(c) for c in _COUNTS], F.max("ends_sha256").alias("_ends"))
    met = materialize(met.join(streamed, "key", "left").withColumn(
        "ends_sha256", F.coalesce("ends", "_ends", F.lit(NO_ENDS))).drop("ends", "_ends"), "open-nodes")
    ids = met.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", *_COUNTS, "ends_sha256"]
    over = met.join(ids, "parent_key", "left").select(out)
    # Nodes inside a block: those whose parent reaches over its edge take its id from there.
    known = shares.join(met.select("key", F.col("conv_id").alias("_id")), "key").select(
        "block", F.col("first").alias("parent_first"), (F.col("depth") + 1).alias("depth"), "_id")
    inside = parts.where("NOT open")
    below = inside.where("parent_first IS NOT NULL").join(known, ["block", "parent_first", "depth"]).withColumn("parent_conv_id", F.col("_id"))
    return inside.where("parent_first IS NULL").select(out).unionByName(below.select(out)).unionByName(over)
