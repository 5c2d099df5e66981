"""What the operators of this subpackage share: worker settings, row numbers, text batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirescope.session import prepare_workers as prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(id_col: str, modulus: int):
    """crc32 of the id as text, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(-1))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string column as numpy views; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if len(column) == 0 or buffers[2] is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at - at[0], np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]]


def byte_texts(column: pa.Array) -> Iterator[bytes]:
    at, data = utf8(column)
    raw = data.tobytes()
    for start, end in zip(at[:-1].tolist(), at[1:].tolist()):
        yield raw[start:end]


def texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


class KeyTable:
    """Position of 64-bit keys in a fixed array, looked up for whole arrays at once (linear probing)."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys.astype(np.uint64), np.uint64(0))  # the last one is never matched
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, len(keys), np.int32)
        self.none = len(keys)
        left = np.arange(len(keys))
        at = self._home(self.keys[:-1])
        while len(left):
            free = self.slots[at] == self.none
            self.slots[at[free]] = left[free]  # of several that want one slot the last stays
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or len(keys of the table) where it is absent."""
        at = self._home(keys)
        out = self.slots[at]
        open_ = np.flatnonzero((out != self.none) & (self.keys[out] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            got = self.slots[at[open_]]
            out[open_] = got
            open_ = open_[(got != self.none) & (self.keys[got] != keys[open_])]
        return out
