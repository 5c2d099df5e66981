"""Byte-level BPE encoding by batched merge rounds, and decoding.

Texts are cut at the special token and into chunks (a run of non-blank characters
with the blank before it, or a run of blanks), chunks into pieces by the
vocabulary's pattern. The ids of all chunks that a batch needs and the worker does
not remember are made together: the symbols of their pieces lie in one flat array,
each round looks every adjacent pair up by binary search over the sorted pair
keys, takes the lowest rank of each piece and merges all its places from left to
right, until no piece has a pair with a rank. Decoding joins the byte strings of
ids by one gather.

Cases: a null text is empty and has no ids; a text of any length is one text, and
a piece may be as long as the text; bytes that are no UTF-8 cannot occur in a text.
"""

from __future__ import annotations

import functools
import gc
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirescope.llm.common import prepare, texts

#: Most chunks whose ids one worker remembers.
CHUNK_MEMORY = 400_000
# White space as the vocabulary's pattern knows it (fixed).
_BLANK = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_PIECE = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_CHUNK = re.compile(rf" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_THREE_BLANKS = re.compile(rf"[{_BLANK}]{{3}}")


def chunks(text: str) -> list[str | tuple[str]]:
    """Chunks whose pieces do not depend on their neighbours: a string stands for a
    blank and that string, a tuple for the string in it.

    Cutting before each blank is right unless a run of blanks spans two cuts,
    which takes three blanks in a row; then the pattern cuts.
    """
    if _THREE_BLANKS.search(text):
        return [c[1:] if c[0] == " " else (c,) for c in _CHUNK.findall(text)]
    first, *rest = text.split(" ")
    return [(first,), *rest] if first else rest


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {chr(b): b for b in printable}
        signs |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token.encode() if token in self.special else bytes(signs[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for sign, b in signs.items():
            self.of_byte[b] = vocab[sign]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memory: dict[str | tuple[str, ...], bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], len(self.keys))

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of many pieces at once, as little-endian unsigned 32-bit integers."""
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        none = len(self.keys)
        rank = np.full(len(ids), none, np.int64)  # of the pair that begins here
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._ranks(ids[inner], ids[inner + 1])
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            spans = np.diff(np.append(heads, len(ids)))
            least = np.repeat(np.minimum.reduceat(rank, heads), spans)
            live = least != none
            ready.append((owner[~live], ids[~live]))
            at = np.flatnonzero(live & (rank == least))
            if len(at):
                # In a run of overlapping places (equal symbols) every second one merges, from the left.
                runs = np.concatenate([[True], np.diff(at) != 1])
                first = np.maximum.accumulate(np.where(runs, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
                ids[at] = self.merged[rank[at]]
                live[at + 1] = False
            # Only pairs with a merged symbol have another rank now.
            fresh = np.zeros(len(ids), bool)
            fresh[at] = True
            ids, owner, rank, fresh = ids[live], owner[live], rank[live], np.flatnonzero(fresh[live])
            fresh = np.concatenate([fresh, fresh - 1])
            fresh = fresh[(fresh >= 0)]
            last = fresh + 1 >= len(ids)
            joined = ~last
            joined[~last] = owner[fresh[~last]] == owner[fresh[~last] + 1]
            rank[fresh[~joined]] = none
            fresh = fresh[joined]
            rank[fresh] = self._ranks(ids[fresh], ids[fresh + 1])
        if not ready:
            return [b""] * len(words)
        owner, ids = (np.concatenate(x) for x in zip(*ready))
        raw = ids[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, new: list[str | tuple[str]]) -> None:
        parts: dict[str, int] = {}
        split: list[int | list[int]] = []
        for key in new:
            if isinstance(key, str) and key.isascii() and key.isalpha():
                split.append(parts.setdefault(" " + key, len(parts)))
            else:
                chunk = " " + key if isinstance(key, str) else key[0]
                split.append([parts.setdefault(p, len(parts)) for p in _PIECE.findall(chunk)])
        packed = self.merge([p.encode("utf-8", "replace") for p in parts])
        for key, own in zip(new, split):
            self.memory[key] = packed[own] if isinstance(own, int) else b"".join([packed[i] for i in own])

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        memory = self.memory
        cut: list[list[str | tuple[str]]] = []
        for text in batch:
            own: list = []
            for i, part in enumerate(self.cut.split(text) if self.cut and "<" in text else [text]):
                if i % 2:
                    own.append((part, "special"))
                elif part:
                    own += chunks(part)
            cut.append(own)
        new = {c for own in cut for c in own if c not in memory}
        if len(memory) + len(new) > CHUNK_MEMORY:  # the memory starts anew
            memory.clear()
            new = {c for own in cut for c in own}
        marks = [c for c in new if len(c) == 2 and isinstance(c, tuple)]
        for c in marks:
            memory[c] = np.array([self.special[c[0]]], "<u4").tobytes()
        self._learn([c for c in new.difference(marks)])
        return [b"".join([memory[c] for c in own]) for own in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids in one gather; each token keeps its order."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        from_ = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.bytes[from_ + np.arange(len(from_))].tobytes()


@functools.cache
def load(path: str) -> ByteBpe:
    """One per worker and vocabulary."""
    gc.set_threshold(200_000, 20, 100)  # the memory is large and has no cycles
    return ByteBpe(path)


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with bpe_ids (little-endian 32-bit), bpe_tokens (their number) and bpe_decoded (text from the ids)."""
    prepare(docs.sparkSession)
    docs = docs.drop("bpe_ids", "bpe_tokens", "bpe_decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("bpe_ids", T.BinaryType()),
                           T.StructField("bpe_tokens", T.LongType()), T.StructField("bpe_decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(vocabulary)
        for batch in batches:
            ids = coder.encode(texts(batch.column(batch.schema.get_field_index(text_col))))
            decoded = [coder.decode(np.frombuffer(i, "<u4")).decode("utf-8", "replace") for i in ids]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()),
                 pa.array(decoded, pa.string())], names=[*batch.schema.names, "bpe_ids", "bpe_tokens", "bpe_decoded"])

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens and the hashes of ids and of the decoded text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return encode(rows, vocabulary).select(
        "doc_id", F.col("bpe_tokens").alias("n_tokens"), F.sha2("bpe_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("bpe_decoded").cast("binary"), 256).alias("decoded_sha256"))
