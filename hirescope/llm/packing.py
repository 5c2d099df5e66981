"""Best-fit packing of tokenised documents by minimum bin slack.

Documents longer than a sequence are cut into full pieces and a rest. What must
be packed is then only a histogram: how many pieces have each of at most
``SEQUENCE`` lengths, however many documents there are. A bin is filled by a
subset-sum over bitsets: starting from the longest length left, the reachable
fills over the lengths available (with their multiplicities) are kept as bits of
an integer, the fullest reachable fill is traced back into a combination, and the
combination is removed as many times as the counts allow. Every such step uses up
a length or leaves fewer of it than the combination needs, so the number of steps
depends on ``SEQUENCE`` alone.

The plan names, per length, which ranks of its pieces go to which combination.
Ranks are dealt out in two levels (groups of about sqrt(n) pieces, then a row
number inside each), so that a length that holds most pieces is no single task.

Cases: a null text is empty; an empty text still has the separator, a piece of
length 1; an empty table gives no rows; repeated rows are packed once each.
"""

from __future__ import annotations

import functools
import gc
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirescope.llm.common import byte_texts, prepare
from hirescope.session import materialize

SEQUENCE = 2048
SEPARATOR = 0
#: Most words whose ids one worker remembers.
WORD_MEMORY = 250_000


# The vocabulary's pattern for printable ASCII in lower case (fixed).
_ASCII_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class WordIds:
    """Token ids of white-space separated words, as little-endian bytes, with a bounded memory.

    The tokenizer drops white space and never joins tokens across it, so a text's
    ids are those of its words. Words of plain Latin letters are lowered and
    split here; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        # Byte-level alphabet of the model: bytes as printable characters.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.signs = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}
        self.memory: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        assert array("I").itemsize == 4 and sys.byteorder == "little"

    def _letters(self, piece: bytes) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            signs = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.signs)
            ids = array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()
            if len(self.pieces) >= WORD_MEMORY:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def _word(self, raw: bytes) -> bytes:
        if raw.isascii():
            low = raw.lower()
            if low.isalpha():
                return self._letters(low)
            if min(low) > 32 and b"<|" not in low:
                return b"".join([self._letters(p) for p in _ASCII_PIECE.findall(low)])
        word = raw.decode("utf-8", "replace")
        # Letters up to Latin Extended-A are composed and have one lower-case form of one letter.
        if max(word) < "\u0180" and "\u0130" not in word and "\u0149" not in word:
            text = word.lower()
            if text.isalpha():
                return self._letters(text.encode())
            if text[:-1].isalpha() and text[-1] in ".,;:!?":
                return self._letters(text[:-1].encode()) + self._letters(text[-1].encode())
        return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()

    def text(self, raw: bytes) -> bytes:
        words = raw.split()
        memory = self.memory
        new = [w for w in words if w not in memory]
        if new:
            if len(memory) + len(new) > WORD_MEMORY:
                memory.clear()
                new = words
            for w in new:
                if w not in memory:
                    memory[w] = self._word(w)
        return b"".join([memory[w] for w in words])


@functools.cache
def word_ids(path: str) -> WordIds:
    """One per worker and vocabulary."""
    gc.set_threshold(200_000, 20, 100)  # the memory is large and has no cycles
    return WordIds(path)


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_row (numbers the row of ``docs``), doc_id, piece, start, length, ids_crc32."""
    prepare(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("doc_row"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    width = 4 * sequence
    end = np.array([SEPARATOR], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for row, doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch.column(2))):
                ids = ids_of.text(raw) + end
                out += [(row, doc, i, at // 4, (min(len(ids), at + width) - at) // 4, zlib.crc32(ids[at : at + width]))
                        for i, at in enumerate(range(0, len(ids), width))]
            if out:
                cols = zip(*out)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 names=["doc_row", "doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, "doc_row long, doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """A combination of the lengths that fills ``room`` as far as possible, longer lengths first.

    ``reach`` has bit f set if some combination fills exactly f.
    """
    reach, steps = 1, []
    limit = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        times = min(counts[length], room // length)
        part = 1
        while times:
            part = min(part, times)
            grown = reach | (reach << (length * part)) & limit
            if grown != reach:
                steps.append((length, part, reach))
                reach = grown
            times -= part
            part *= 2
        if reach >> room & 1:
            break
    fill = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, part, before in reversed(steps):
        if not before >> fill & 1:
            taken[length] = taken.get(length, 0) + part
            fill -= length * part
    return taken


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many sequences have each."""
    counts = {k: v for k, v in histogram.items() if v}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        taken = fullest(counts, sequence - longest)
        counts[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in taken.items())
        for k, n in taken.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((taken, times))
    return out


def _places(found: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length, by first rank: rank, pieces of it in a sequence, first sequence, offset of the first one."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    first = 0
    for taken, times in found:
        offset = 0
        for length, n in sorted(taken.items(), reverse=True):
            rows.setdefault(length, []).append((used.get(length, 0), n, first, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        first += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(cut: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``cut`` (rows of :func:`pieces`, written) with sequence_id and offset."""
    spark = prepare(cut.sparkSession)
    # At most ``sequence`` rows.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    held = spark.sparkContext.broadcast(_places(plan(histogram, sequence)))
    groups = spark.createDataFrame([(k, max(1, round(v**0.5))) for k, v in histogram.items()] or [(0, 1)],
                                   "length long, _groups long")
    dealt = cut.join(F.broadcast(groups), "length").withColumn(
        "_group", F.pmod(F.xxhash64("doc_row", "piece"), F.col("_groups"))).drop("_groups")
    sizes = dealt.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_group")) - F.col("_n")
    starts = sizes.select("length", "_group", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_row", "piece")) - 1
    ranked = dealt.withColumn("_inside", inside).join(starts, ["length", "_group"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_inside"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank, length = batch["_rank"].to_numpy(), batch["length"].to_numpy()
            seq, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for value in np.unique(length):
                own = length == value
                table = held.value[value]
                at = table[np.searchsorted(table[:, 0], rank[own], "right") - 1]
                past = rank[own] - at[:, 0]
                seq[own] = at[:, 2] + past // at[:, 1]
                offset[own] = at[:, 3] + past % at[:, 1] * value
            yield batch.drop(columns="_rank").assign(sequence_id=seq, offset=offset)

    return ranked.select("doc_row", "doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInPandas(
        place, "doc_row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                   sequence: int = SEQUENCE) -> DataFrame:
    return pack(materialize(pieces(docs, vocabulary, id_col, text_col, sequence), "pieces"), sequence)
