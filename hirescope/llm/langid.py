"""Language identification by prediction by partial matching over bytes.

For each language a context tree of order ``ORDER`` holds how often each byte
followed each context of 0 to ORDER bytes. Its statistics are frozen after
training, so a text's code length is a sum over its bytes: the longest context
that was seen codes the byte if it followed there, else an escape (method C:
d / (n + d) with d different bytes after n occurrences) and the next shorter
context; below order 0 every byte costs 8 bits. The language with the shortest
code wins and the score is its share of 2^-length over all languages.

Cases: a null text, or one without any letter, is ``und`` with score 0, and so is
every text if there is nothing to learn from; ties go to the first language by
name; repeated rows give repeated results; other columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirescope.llm.common import KeyTable, id_bucket, prepare, utf8

ORDER = 4
#: Expected number of documents that a language is learned from, whatever the size of the table.
SAMPLE_DOCS = 400
_WINDOW = 1 << 19
_PAD = b"\n" * ORDER


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """At every position the last order + 1 bytes as one number; the first ORDER positions are padding."""
    out = data[ORDER:].astype(np.uint64)
    for back in range(1, order + 1):
        out |= data[ORDER - back : len(data) - back].astype(np.uint64) << np.uint64(8 * back)
    return out


@dataclass
class Trees:
    """Code lengths in bits of all languages: rows by gram or context, columns by language."""

    langs: list[str]
    known: list[KeyTable]  # per order: grams seen in any language
    bits: list[np.ndarray]
    contexts: list[KeyTable]  # per order: contexts seen in any language
    escapes: list[np.ndarray]

    def lengths(self, data: np.ndarray) -> np.ndarray:
        """Bits per byte of ``data`` after its ORDER bytes of padding, by language."""
        whole = grams(data, ORDER)
        out = np.zeros((len(whole), len(self.langs)), np.float32)
        left = np.arange(len(whole))
        for order in range(ORDER, -1, -1):
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            keys = whole[left] & mask
            at = self.known[order].find(keys)
            hit = at != self.known[order].none
            out[left[hit]] += self.bits[order][at[hit]]
            left, keys = left[~hit], keys[~hit]
            if not len(left):
                break
            out[left] += self.escapes[order][self.contexts[order].find(keys >> np.uint64(8))]
        out[left] += 8.0
        return out


def _count(texts: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    raw = _PAD + _PAD.join(t.encode("utf-8", "replace") for t in texts)
    data = np.frombuffer(raw, np.uint8)
    return [np.unique(grams(data, k), return_counts=True) for k in range(ORDER + 1)]


def build(counted: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Trees:
    """Frozen code lengths from the gram counts of each language."""
    langs = sorted(counted)
    known, bits, contexts, escapes = [], [], [], []
    for k in range(ORDER + 1):
        keys = np.unique(np.concatenate([counted[x][k][0] for x in langs]))
        ctxs = np.unique(keys >> np.uint64(8))
        code = np.full((len(keys), len(langs)), np.nan, np.float32)
        esc = np.zeros((len(ctxs) + 1, len(langs)), np.float32)
        for col, lang in enumerate(langs):
            own, n = counted[lang][k]
            at = np.searchsorted(ctxs, own >> np.uint64(8))
            total = np.bincount(at, n, len(ctxs)) + np.bincount(at, minlength=len(ctxs))
            kinds = np.bincount(at, minlength=len(ctxs))
            code[np.searchsorted(keys, own), col] = np.log2(total[at] / n)
            seen = kinds > 0
            esc[:-1][seen, col] = np.log2(total[seen] / kinds[seen])
        table = KeyTable(keys)
        if k:
            shorter = known[k - 1].find(keys & np.uint64((1 << 8 * k) - 1))
            below = np.vstack([bits[k - 1], np.full((1, len(langs)), 8.0, np.float32)])[shorter]
        else:
            below = np.full((len(keys), len(langs)), 8.0, np.float32)
        miss = np.isnan(code)
        code[miss] = (below + esc[np.searchsorted(ctxs, keys >> np.uint64(8))])[miss]
        known.append(table)
        bits.append(code)
        contexts.append(KeyTable(ctxs))
        escapes.append(esc)
    return Trees(langs, known, bits, contexts, escapes)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS) -> Trees | None:
    """Learn from about ``sample_docs`` whole documents of each language, taken by a hash of the id.

    The sample is bounded by that number and by the number of languages, so the
    trees are too. None if no row has both a text and a language.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    rows = rows.where("_text is not null and _lang is not null")
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items())
                           for x in (lang, min(1.0, sample_docs / n))])
    spot = F.pmod(F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(spot < F.element_at(share, F.col("_lang"))).dropDuplicates(["_lang", "_id"])

    def count(part: pd.DataFrame) -> pd.DataFrame:
        found = _count(part.sort_values("_id")["_text"])
        return pd.DataFrame({"lang": part["_lang"].iloc[0], "k": range(ORDER + 1),
                             "grams": [g.tobytes() for g, _ in found], "n": [n.astype(np.int64).tobytes() for _, n in found]})

    got = sample.groupBy("_lang").applyInPandas(count, "lang string, k int, grams binary, n binary").collect()
    counted: dict[str, list] = {r["lang"]: [None] * (ORDER + 1) for r in got}
    for r in got:
        counted[r["lang"]][r["k"]] = (np.frombuffer(bytes(r["grams"]), np.uint64), np.frombuffer(bytes(r["n"]), np.int64))
    return build(counted) if counted else None


def classify(trees: Trees, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of one batch."""
    at, data = utf8(column)
    rows, langs = len(at) - 1, len(trees.langs)
    # Every text is preceded by padding, so no context reaches into its neighbour.
    lengths = np.diff(at)
    flat = np.full(len(data) + ORDER * rows, 10, np.uint8)
    place = np.arange(len(data)) + np.repeat(ORDER * np.arange(1, rows + 1), lengths)
    flat[place] = data
    owner = np.repeat(np.arange(rows), lengths + ORDER)
    counts_here = np.zeros(len(flat), bool)
    counts_here[place] = True
    total = np.zeros((rows, langs))
    for start in range(ORDER, len(flat), _WINDOW):
        end = min(len(flat), start + _WINDOW)
        bits = trees.lengths(flat[start - ORDER : end])
        bits[~counts_here[start:end]] = 0
        first, last = owner[start], owner[end - 1] + 1
        for col in range(langs):
            total[first:last, col] += np.bincount(owner[start:end] - first, bits[:, col], last - first)
    best = total.argmin(1)
    score = 1 / np.exp2(np.clip(total[np.arange(rows), best][:, None] - total, -1000, 0)).sum(1)
    pred = [trees.langs[b] for b in best]
    for i, text in enumerate(column.to_pylist()):
        if text is None or not any(map(str.isalpha, text)):
            pred[i], score[i] = "und", 0.0
    return pred, score


def identify(docs: DataFrame, trees: Trees | None, text_col: str = "text",
             out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score; ``out`` replace columns of the same names."""
    spark = prepare(docs.sparkSession)
    docs = docs.drop(*out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])
    held = spark.sparkContext.broadcast(trees)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if held.value is None:
                pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                pred, score = classify(held.value, batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=[*batch.schema.names, *out])

    return docs.mapInArrow(predict, schema)


def held_out(id_col: str = "doc_id"):
    return id_bucket(id_col, 4) == 2
