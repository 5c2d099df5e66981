"""Quality rules: word and line counts of a document, and lines that recur across documents.

Base rules reject documents under ``MIN_WORDS`` words or with more than half of
their words in repeated 3-word windows. The rest is judged by its lines: each
line with a word is normalised (lower case, digits as one sign, words joined by
single blanks) and hashed; per host the documents that hold it are counted (each copy
of a page is one), and lines held by more than ``MAX_DOCUMENTS`` of them are removed
from all but the first of these documents, by id and then text, and its exact copies. A
document is depleted, and rejected, if less than ``MIN_LEFT`` of its words stay. So of a group of
documents with the same lines, however large and whatever their numbers, one text is left,
and its copies for de-duplication. The verdict hangs on ids and texts alone, not on how the
table is cut. Nothing is sampled or capped; hot lines and hosts are summed in
two steps (line and document, then line).

Cases: a null or blank text has no words and fails the base rules; a null host is
a host of its own; repeated rows are judged as copies, each with a row of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirescope.llm.common import byte_texts, prepare, texts
from hirescope.session import materialize

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_DOCUMENTS = 100
MIN_LEFT = 0.3
_SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
_DIGITS = re.compile(rb"[0-9]+")

_SCHEMA = """doc_row long, doc_id long, tag long, host string, n_words long, word_chars long, n_symbols long,
n_dup_lines long, n_repeat_words long, lines array<struct<line: long, words: long>>, whole long"""


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 20:  # keys of three words would not fit
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + len(windows)] |= twice
    return int(covered.sum())


def line_facts(raw: bytes) -> tuple[int, dict[int, int]]:
    """Lines equal to an earlier one; hash of each normalised line with its words, once per line of text."""
    repeated, seen, lines = 0, set(), {}
    for line in raw.split(b"\n"):
        words = line.split()
        if not words:
            continue
        repeated += line in seen
        seen.add(line)
        plain = _DIGITS.sub(b"0", b" ".join(words).lower())
        key = xxhash.xxh3_64_intdigest(plain)
        lines[key] = lines.get(key, 0) + len(words)
    return repeated, lines


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                "lines", "whole")}
        for raw, text in zip(byte_texts(col["text"]), texts(col["text"])):
            words = raw.split()
            repeated, lines = line_facts(raw)
            out["n_words"].append(len(words))
            out["word_chars"].append(len(text) - sum(map(text.count, _BLANKS)))
            out["n_symbols"].append(sum(map(text.count, _SYMBOLS)))
            out["n_dup_lines"].append(repeated)
            out["n_repeat_words"].append(repeated_words(words))
            out["lines"].append([{"line": _signed(k), "words": n} for k, n in lines.items()])
            out["whole"].append(_signed(xxhash.xxh3_64_intdigest(raw)))
        kinds = {"lines": pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))}
        yield pa.RecordBatch.from_arrays(
            [col["doc_row"], col["doc_id"], col["tag"], col["host"], *[pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()]],
            names=["doc_row", "doc_id", "tag", "host", *out])


def common_lines(facts: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(host, line, first): lines held by more than ``max_documents`` documents of the host,
    and the hash of the text of the first of them."""
    line = facts.select("host", F.explode("lines.line").alias("line"), "whole", "doc_id")
    holders = line.groupBy("host", "line", "whole").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id")).alias("id"), F.count("*").alias("copies"))
    counted = holders.groupBy("host", "line").agg(F.sum("copies").alias("n"), F.min(F.struct("id", "whole"))["whole"].alias("first"))
    return counted.where(F.col("n") > max_documents).drop("n")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          max_documents: int = MAX_DOCUMENTS, min_left: float = MIN_LEFT, tag: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_row (its number), doc_id, tag, the counts, words_left, base_failed and kept.

    ``tag`` names a column of numbers to hand through.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("doc_row"),
        F.col(id_col).cast("long").alias("doc_id"),
        (F.col(tag) if tag else F.lit(None)).cast("long").alias("tag"),
        F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit("")).alias("host"),
        F.col(text_col).cast("string").alias("text"))
    facts = materialize(rows.mapInArrow(_facts, _SCHEMA), "quality-facts")
    common = common_lines(facts, max_documents)
    held = facts.select("doc_row", "host", "whole", F.explode("lines").alias("l")).select(
        "doc_row", "host", "whole", "l.line", "l.words")
    removed = held.join(common, ["host", "line"]).where("whole <> first").groupBy("doc_row").agg(F.sum("words").alias("_removed"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("_removed", F.lit(0))
    return (
        facts.drop("lines", "host", "whole").join(removed, "doc_row", "left")
        .withColumn("words_left", left).drop("_removed")
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= min_left * F.col("n_words")))
    )
