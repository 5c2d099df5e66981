"""Fixtures and edge cases of these tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, lang[, source]])."""

    def build(*rows, extra=""):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


#: Null and empty texts, blanks only, repeated rows, null id, odd characters and a long text.
EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "two words"), (5, "é ß İ ́x \x1c <|endoftext|> a\\b <|im_end|>"),
    (6, "word " * 5000), (7, None, None, None), (8, "tab\there  and   there\n\nline\n"),
]
