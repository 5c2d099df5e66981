"""Personal data and secrets by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, URL schemes and identifier cues.
From each anchor a deterministic local parser reads outward and validates what it
found: e-mail boundaries around an at-sign, the authority and path after a scheme,
the value after a cue such as ``password=`` or ``iban``. A cue may end a longer
name (``db_password``, ``x-api-key``) and stand in quotes; only a letter or digit
before it makes it part of another word. Numbers have no cue, so
IP addresses, cards and phone numbers anchor on their own digits: a maximal chain
is taken once and validated (parts at most 255; 12 to 19 digits passing Luhn; 9 to
15 digits), and dropped whole if it fails. All parsers take time in proportion to
the text, whatever it holds.

A span is (kind, start, end) in code points, end exclusive. Spans of different
kinds may overlap; spans of one kind do not.

Cases: a null text is empty and has no spans; repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirescope.llm.common import prepare, texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "secret", "account")
#: Anchors by parser; cues are matched in lower case.
CUES = {
    "@": "email", "http://": "url", "https://": "url", "ftp://": "url",
    "password": "secret", "passwd": "secret", "secret": "secret", "api_key": "secret", "apikey": "secret",
    "access_token": "secret", "auth_token": "secret", "akia": "key_id",
    "api-key": "secret", "access-token": "secret", "auth-token": "secret", "accesstoken": "secret", "authtoken": "secret",
    "access_key": "secret", "access-key": "secret", "accesskey": "secret", "secretaccesskey": "secret",
    "secret_key": "secret", "secret-key": "secret", "secretkey": "secret", "clientsecret": "secret",
    "private_key": "secret", "private-key": "secret", "privatekey": "secret",
    "iban": "iban", "ssn": "ssn", "account": "account", "passport": "account",
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
#: A key between PEM marks has no hyphen, so that looking for its end takes linear time.
_VALUE = re.compile(r"-----BEGIN [A-Z ]+-----[^-]+-----END [A-Z ]+-----|[^\s\"',;]{6,}")
#: What stands between a cue and its value.
_EQUALS = re.compile(r"[\"']?\s?[=:]\s?[\"']?")
_KEY_ID = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
_IBAN = re.compile(r"[\"']?[\s:=#.-]{0,3}[\"']?([A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?)(?![0-9A-Za-z])")
_SSN = re.compile(r"[\"']?[\s:=#.-]{0,3}[\"']?([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_NUMBER = re.compile(r"[\s_-]?(?:number|no\.?|nr\.?|id)?[\"']?[\s:=#]{0,3}[\"']?([A-Z]{0,3}[0-9][0-9 -]{5,20}[0-9])(?![0-9A-Za-z])", re.IGNORECASE)

Span = tuple[str, int, int]


@functools.cache
def _anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for cue, parser in CUES.items():
        automaton.add_word(cue, (len(cue), parser))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _numbers(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                yield "phone", m.start(), m.end()


def _word_before(text: str, at: int) -> bool:
    return at > 0 and text[at - 1].isalnum()


def find(text: str) -> list[Span]:
    """All spans of a text by start, then kind in the order of ``KINDS``."""
    spans = list(_numbers(text))
    folded = text.lower()
    if len(folded) != len(text):  # a letter became two: fold ASCII only, so that offsets stay those of the text
        folded = text.translate(_ASCII_LOWER)
    ends = dict.fromkeys(KINDS, 0)  # where the last span of a kind ended
    for last, (length, parser) in _anchors().iter(folded):
        at, after = last + 1 - length, last + 1
        found = None
        if parser == "email":
            m, start = _DOMAIN.match(text, at), at
            while m and start > ends["email"] and text[start - 1] in _LOCAL:
                start -= 1
            found = ("email", start, m.end()) if start < at else None
        elif _word_before(text, at):
            continue
        elif parser == "url":
            # Inside a span of its kind nothing is read again, here and for secrets: so all reading is linear.
            if at >= ends["url"] and (m := _URL.match(text, after)):
                end = after + len(m[0].rstrip(".,;:!?)]"))
                found = ("url", at, end) if end > after else None
        elif parser == "secret":
            m = _EQUALS.match(text, after)
            if m and m.end() >= ends["secret"] and (m := _VALUE.match(text, m.end())):
                found = ("secret", m.start(), m.end())
        elif parser == "key_id":
            m = _KEY_ID.match(text, at)
            found = ("secret", at, m.end()) if m else None
        else:
            m = {"iban": _IBAN, "ssn": _SSN, "account": _NUMBER}[parser].match(text, after)
            found = ("account", m.start(1), m.end(1)) if m and (parser != "iban" or iban_valid(m[1])) else None
        if found and found[1] >= ends[found[0]]:
            spans.append(found)
            ends[found[0]] = found[2]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: What a span is replaced by.
MASKS = {k: f"[{k.upper()}]" for k in KINDS}


def mask(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans replaced by the mask of the first (longest) one there."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], MASKS[kind]]
        done = max(done, end)
    return "".join([*out, text[done:]])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, text_col: str = "text", out: tuple[str, str] = ("pii_spans", "pii_masked")) -> DataFrame:
    """``docs`` with the spans (array of kind, start, end) and the text with masks in their place;
    ``out`` replace columns of the same names."""
    prepare(docs.sparkSession)
    docs = docs.drop(*out)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(out[0], T.ArrayType(span)),
                           T.StructField(out[1], T.StringType())])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            found = [find(t) for t in texts(column)]
            masked = [t if not s else mask(t, s) for t, s in zip(column.to_pylist(), found)]
            listed = [[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(listed, arrow), pa.array(masked, pa.string())],
                                             names=[*batch.schema.names, *out])

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the number of spans of each base kind, their hash, and all spans as text."""
    spans = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    as_text = lambda s: F.concat_ws(",", F.transform(
        s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("pii_spans", lambda x: x["kind"].isin(*BASE_KINDS))
    of = lambda kind: F.size(F.filter("pii_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *[of(k) for k in BASE_KINDS],
                        F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("pii_spans")).alias("spans"))
