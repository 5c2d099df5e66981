"""String helpers with Unicode-aware whitespace and case handling."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters Unicode counts as whitespace, plus the four ASCII separators
# that Java's \s leaves out.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# Regex flags: case-insensitive, Unicode classes, only \n ends a line.
FLAGS = "(?iUd)"
SPACE = r"[\s\x1c-\x1f]"
# The digit beyond the BMP is in \p{N} already; with it Java's look-behind steps by whole characters, not surrogates.
WORD = r"[\p{L}\p{N}_%s]" % "\U0001d7d8"


def quote(literal: str) -> str:
    """Regex for a literal, valid in Java."""
    return re.sub(r"([^\w\s])", r"\\\1", literal)


def strip(c: Column) -> Column:
    """Remove whitespace of any kind (tab, newline, no-break space ...) at both ends."""
    return F.btrim(c, F.lit(SPACES))


def text_or(c: Column, default: Column | str) -> Column:
    """``c`` unless it is null or empty."""
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(c, F.lit("")), fallback)


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def merged_pattern(terms: Mapping[str, str]) -> str:
    """Regex matching the longest of many literals (term -> pattern that must follow it).

    The terms are merged by common prefix and long lists of branches are halved
    by their first character, so a position is left after a few character tests
    instead of one attempt per term.
    """

    def alternatives(options: list[tuple[str, str]]) -> str:
        if len(options) <= 6:
            return "|".join(regex for _, regex in options)
        middle = len(options) // 2
        halves = []
        for part in (options[:middle], options[middle:]):
            heads = "".join(quote(head) for head, _ in part)
            halves.append(f"(?=[{heads}])(?:{alternatives(part)})")
        return "|".join(halves)

    branches: dict[str, dict[str, str]] = defaultdict(dict)
    for term, end in terms.items():
        if term:
            branches[term[0]][term[1:]] = end
    body = [alternatives([(head, quote(head) + merged_pattern(rest)) for head, rest in sorted(branches.items())])]
    if "" in terms:
        body.append(terms[""])  # shorter term last: the longest one wins
        return "(?:" + "|".join(body) + ")" if branches else body[-1]
    return body[0] if len(branches) <= 1 else "(?:" + body[0] + ")"


def contains_any(c: Column, words: Iterable[str], whole_words: bool = False) -> Column:
    """True if ``c`` contains one of ``words`` (substring test unless ``whole_words``).

    One pattern for the whole list: the input expression appears once, which
    keeps filters small enough for code generation.
    """
    words = list(words)
    if not words:
        return F.lit(False)
    if whole_words:
        any_word = merged_pattern({w.strip(): f"(?!{WORD})" for w in words})
        return c.rlike(f"(?<!{WORD}){any_word}")
    if len(words) <= 2:
        return reduce(or_, [c.contains(w) for w in words])
    return c.rlike(merged_pattern({w: "" for w in words}))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Filters do not share common subexpressions, and Spark copies filtered columns
    down to the scan: a lower-cased text used by ten tests would be made ten
    times. As the variable of a one-element array it is made once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_contained(c: Column, words: Iterable[str]) -> Column:
    """How many of ``words`` occur in a long text. Byte search beats a pattern here."""
    return bind(c, lambda text: sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)))


def mentions_any(c: Column, words: Iterable[str]) -> Column:
    """:func:`contains_any` for long texts."""
    return bind(c, lambda text: reduce(or_, [F.contains(text, F.lit(w)) for w in words], F.lit(False)))


def first_contained(c: Column, choices: Mapping[str, Iterable[str]] | Iterable[tuple[str, Iterable[str]]]) -> Column:
    """Label of the first choice that has a word contained in ``c``, else null."""
    pairs = choices.items() if isinstance(choices, Mapping) else choices
    return F.coalesce(*[F.when(contains_any(c, words), F.lit(label)) for label, words in pairs])


def literal_map(table: Mapping[str, str]) -> Column:
    """A constant map. As one SQL expression it is built in one call, however many entries it has."""

    def quoted(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in table.items()) + ")")


def lookup(c: Column, table: Mapping[str, str]) -> Column:
    """Value of ``c`` in a small literal map, null when absent."""
    return F.try_element_at(literal_map(table), c)


def title_case(c: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the others.

    ``initcap`` only looks at spaces ("booking-holding" would keep its second
    half small), so the text is cut at the borders between letters and others.
    """
    runs = F.regexp_extract_all(c, F.lit(r"(?U)\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(
            runs,
            lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.lower(F.substr(run, F.lit(2)))),
        ),
        "",
    )


def drop_tags(c: Column) -> Column:
    """HTML tags and runs of whitespace become one space; ends are trimmed."""
    return strip(
        F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), f"(?U){SPACE}+", " ")
    )


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    """The named HTML entities that occur in attribute values and short labels."""
    for entity, char in _ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def element_text(c: Column) -> Column:
    """Text of an HTML fragment: tags removed, each piece trimmed, pieces joined."""
    pieces = F.split(c, r"<[^>]+>")
    return F.array_join(F.transform(pieces, lambda p: strip(unescape(p))), "")


def fingerprint(source: Column, external_id: Column) -> Column:
    return F.md5(F.concat_ws(":", blank_if_null(source), blank_if_null(external_id)))
