"""SimHash near-duplicates by tiled exact comparison.

A text is its lower-cased words' 3-word shingles, repeats included; its fingerprint
has the bits that are set in over half of the shingles' 64-bit hashes. Documents
link where fingerprints differ in at most ``RADIUS`` bits, and are classed by the
components of these links.

Equal fingerprints are one node. A tile holds the fingerprints whose halves (or
smaller parts, if there are many) have the same population counts. Fingerprints
within the radius differ by at most that much in the sum of these counts, so all
other tile pairs are skipped; each tile is compared with itself and with those of its
neighbours that come before it, by exclusive-or and bit counts of numpy arrays. Large
tile pairs are cut into smaller tiles by the counts of smaller parts, down to
bytes, by the same rule. A tile of more than about ``BLOCK`` fingerprints is cut
into blocks; its neighbours stream past one block at a time.

A task gives for every fingerprint of a tile the least one it is connected to
there, never a row per pair; components over these links are found by star steps.

Cases: null, empty and blank texts have fingerprint zero, linked like any other;
fewer than three words are one shingle; repeated rows are copies; a null id is
never the least; an empty table gives no rows; texts of any length are taken whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirescope.llm.common import byte_texts, prepare
from hirescope.functions.graph import components, join_counted
from hirescope.session import materialize

WORDS = 3
SEED = 42
RADIUS = 3
#: Fingerprints of one block of a tile, held by one task.
BLOCK = 1 << 18
#: Pairs that are compared at once.
AT_ONCE = 1 << 18
#: Bits of a part, by step of cutting a pair of tiles.
STEPS = (32, 16, 8)
_CHUNK = 1 << 14


def fingerprint(raw: bytes) -> int:
    """Majority of the bits of the hashes of all shingles of a UTF-8 text."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(WORDS)]))
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(s, SEED) for s in shingles], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(raw) for raw in byte_texts(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def part_counts(fps: np.ndarray, bits: int) -> np.ndarray:
    """Population counts (rows, parts) of the parts of ``bits`` bits, highest part first."""
    shifts = np.arange(64 - bits, -1, -bits).astype(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    return np.bitwise_count((fps[:, None] >> shifts[None, :]) & mask).astype(np.int64)


def tile_number(counts: np.ndarray, bits: int) -> np.ndarray:
    key = np.zeros(counts.shape[:-1], np.int64)
    for i in range(counts.shape[-1]):
        key = key * (bits + 1) + counts[..., i]
    return key


def tile_column(fp: Column, bits: int) -> Column:
    """``tile_number`` as a column."""
    key = F.lit(0).cast("long")
    for shift in range(64 - bits, -1, -bits):
        key = key * (bits + 1) + F.bit_count(F.shiftrightunsigned(fp, shift).bitwiseAND((1 << bits) - 1))
    return key


def neighbour_steps(bits: int) -> np.ndarray:
    """Differences of counts (steps, parts) to the tiles in reach that do not come before a tile; zero first."""
    parts = 64 // bits
    found = {(0,) * parts}
    for _ in range(RADIUS):
        found |= {v[:i] + (v[i] + s,) + v[i + 1 :] for v in found for i, s in itertools.product(range(parts), (-1, 1))}
    return np.array(sorted(v for v in found if v >= (0,) * parts), np.int64)


def part_bits(n: int) -> int:
    """Bits of a part so that ``n`` fingerprints are sent to the fewest blocks. The share of the largest tile is
    taken as that of independent even bits."""
    def sent(bits: int) -> float:
        largest = (np.prod([(bits - i) / (bits // 2 - i) for i in range(bits // 2)]) / 2.0**bits) ** (64 // bits)
        return len(neighbour_steps(bits)) * max(1.0, n * largest / BLOCK)

    return min(STEPS, key=sent)


def _spread(bits: int, steps: np.ndarray):
    """fp -> (tile, own, fp), its own tile and those in reach that come after it."""
    rows_at_once = max(1, (1 << 16) // len(steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fps), rows_at_once):
                fps = all_fps[at : at + rows_at_once]
                counts = part_counts(fps, bits)[:, None, :] + steps[None, :, :]
                fits = ((counts >= 0) & (counts <= bits)).all(2)
                row, step = np.nonzero(fits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tile_number(counts, bits)[fits]), pa.array(step == 0), pa.array(fps[row].view(np.int64))],
                    names=["tile", "own", "fp"])

    return run


def _groups(fps: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    counts = part_counts(fps, bits)
    _, first, inverse = np.unique(tile_number(counts, bits), return_index=True, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    return counts[first], np.split(order, np.cumsum(np.bincount(inverse))[:-1])


def near_pairs(a: np.ndarray, b: np.ndarray, at: np.ndarray | None = None, bt: np.ndarray | None = None,
               step: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes (into a, into b) of all pairs of fingerprints within the radius."""
    at = np.arange(len(a)) if at is None else at
    bt = np.arange(len(b)) if bt is None else bt
    if not len(at) or not len(bt):
        return
    if len(at) * len(bt) > AT_ONCE and step < len(STEPS):
        ca, ga = _groups(a[at], STEPS[step])
        cb, gb = _groups(b[bt], STEPS[step])
        width = max(1, AT_ONCE // (len(cb) * cb.shape[1]))
        for start in range(0, len(ca), width):
            apart = np.abs(ca[start : start + width, None, :] - cb[None, :, :]).sum(2)
            for i, j in zip(*np.nonzero(apart <= RADIUS)):
                yield from near_pairs(a, b, at[ga[start + i]], bt[gb[j]], step + 1)
        return
    wide = b[bt]
    rows = max(1, AT_ONCE // min(len(bt), AT_ONCE))
    for start in range(0, len(at), rows):
        some = a[at[start : start + rows]]
        for left in range(0, len(wide), AT_ONCE):
            i, j = np.nonzero(np.bitwise_count(some[:, None] ^ wide[None, left : left + AT_ONCE]) <= RADIUS)
            if len(i):
                yield at[start + i], bt[left + j]


class _Tile:
    """The fingerprints of one block of a tile, and to which of them each is connected."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.parent = np.arange(len(fps))
        for i, j in near_pairs(fps, fps):
            self.join(i, j)

    def roots(self, i: np.ndarray) -> np.ndarray:
        up = self.parent[i]
        while True:
            over = self.parent[up]
            if (over == up).all():
                return up
            up = over

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.roots(i), self.roots(j)
        apart = a != b
        for x, y in np.unique(np.stack([a[apart], b[apart]]), axis=1).T.tolist():
            while self.parent[x] != x:
                x = int(self.parent[x])
            while self.parent[y] != y:
                y = int(self.parent[y])
            if x != y:
                self.parent[max(x, y)] = min(x, y)
        self.parent[i] = self.roots(i)
        self.parent[j] = self.roots(j)

    def passed(self, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links from streamed fingerprints to one of the tile each; those that one of them joins are joined."""
        for i, j in near_pairs(others, self.fps):
            row, start = np.unique(i, return_index=True)  # i ascends
            head = np.repeat(j[start], np.diff(np.append(start, len(i))))
            self.join(head, j)
            yield others[row], self.fps[j[start]]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        root = self.roots(np.arange(len(self.fps)))
        moved = root != np.arange(len(root))
        return self.fps[moved], self.fps[root[moved]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, block, other, fp) sorted by these, own ones first -> (a, b) links."""
    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    key, own, tile = None, [], None

    def tile_now() -> _Tile:
        return _Tile(np.concatenate(own) if own else np.zeros(0, np.uint64))

    for batch in batches:
        if not batch.num_rows:
            continue
        col = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        edges = np.flatnonzero((np.diff(col[0]) != 0) | (np.diff(col[1]) != 0) | (np.diff(col[2]) != 0)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            if (col[0][start], col[1][start]) != key:
                if key is not None:
                    yield out(*(tile or tile_now()).links())
                key, own, tile = (col[0][start], col[1][start]), [], None
            fps = col[3][start:end].view(np.uint64)
            if col[2][start] == 0:
                own.append(fps)
                continue
            if tile is None:
                tile, own = tile_now(), []
            for a, b in tile.passed(fps):
                yield out(a, b)
    if key is not None:
        yield out(*(tile or tile_now()).links())


def links(fps: DataFrame, n: int, block: int = BLOCK, bits: int | None = None) -> DataFrame:
    """Links (a, b) that join the ``n`` distinct fingerprints ``fp`` as all pairs within the radius do."""
    bits = bits or part_bits(n)
    own = fps.groupBy(tile_column(F.col("fp"), bits).alias("tile")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = materialize(own, "tiles")
    if bits > 8:  # at most 17^4 tiles
        own = F.broadcast(own)
    spread = fps.select("fp").mapInArrow(_spread(bits, neighbour_steps(bits)), "tile long, own boolean, fp long")
    home = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = spread.join(own, "tile").withColumn("_home", home)
    # An own fingerprint is held by its block and streams past the blocks after it.
    first = F.when(F.col("own"), F.col("_home")).otherwise(0)
    rows = rows.withColumn("block", F.explode(F.sequence(first, F.col("blocks") - 1)))
    other = F.when(F.col("own") & (F.col("block") == F.col("_home")), 0).otherwise(1)
    rows = rows.select("tile", "block", other.alias("other"), "fp")
    return rows.repartition("tile", "block").sortWithinPartitions("tile", "block", "other").mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
                    bits: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (the fingerprint as a signed number) and component_id, the least id of its class."""
    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(slim.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n")), "nodes")
    n, n_rows = nodes.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    joined = components(links(nodes.select("fp"), n, block, bits))
    # Class of each node, its least id, and that id at each node.
    classed = materialize(nodes.join(joined.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least", "_n"), "classed")
    ids = materialize(classed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n")), "class-ids")
    known = materialize(join_counted(classed.withColumnRenamed("_n", "_rows"), ids, "root", n).select(
        "fp", "component_id", F.col("_rows").alias("_n")), "known")
    return join_counted(rows, known, "fp", n_rows).select("doc_id", "fp", "component_id")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(docs, id_col, text_col)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
