"""Skills from landed model answers (JSON text), with the extracted skills as fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirescope.config import Config
from hirescope.functions.text import blank_if_null, strip
from hirescope.operators.skills import category_column
from hirescope.schemas import SKILL_HITS


def _parsed(content: Column) -> Column:
    """The JSON document, else the outermost {...} block of the text, else null."""
    block = F.nullif(F.regexp_extract(content, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(F.try_parse_json(content), F.try_parse_json(block))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "string")


def _items(doc: Column) -> Column:
    """The skill list: the ``skills`` field of an object, or a bare list."""
    return F.coalesce(
        F.try_variant_get(doc, "$.skills", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>")
    )


def _is_object(item: Column) -> Column:
    return _kind(item).startswith("OBJECT")


def _truthy(v: Column) -> Column:
    text = _text(v, "$.is_required")
    return F.coalesce(~text.isin("", "false", "0", "0.0", "[]", "{}"), F.lit(False))


def parse_answer(content: Column, cfg: Config) -> Column:
    """Array of skill hits, or null if the answer is unusable (bad JSON, no list, nameless entry)."""
    items = _items(_parsed(content))
    named = F.transform(
        items,
        lambda i: F.struct(
            F.lower(strip(F.when(_is_object(i), _text(i, "$.name")).otherwise(_text(i)))).alias("name"),
            F.nullif(F.when(_is_object(i), _text(i, "$.category")), F.lit("")).alias("category"),
            F.when(_is_object(i), _truthy(i)).otherwise(F.lit(False)).alias("is_required"),
        ),
    )
    whole = F.when(~F.exists(named, lambda n: n["name"].isNull()), named)
    filled = F.filter(whole, lambda n: n["name"] != "")
    # First entry of a name wins: keep an entry if it sits at its name's first position.
    names = F.transform(filled, lambda n: n["name"])
    firsts = F.filter(filled, lambda n, i: F.array_position(names, n["name"]) == i + 1)
    hits = F.transform(
        firsts,
        lambda n: F.struct(
            n["name"].alias("name"),
            F.coalesce(n["category"], category_column(n["name"], cfg)).alias("category"),
            n["is_required"].alias("is_required"),
            F.lit(1).alias("count"),
        ),
    )
    return F.when(F.size(hits) > 0, hits).cast(SKILL_HITS)


def skills_from_answers(extracted: DataFrame, answers: DataFrame, cfg: Config) -> DataFrame:
    """Replaces ``skills`` by the answer's where one is usable.

    ``answers`` has ``text_hash``, ``content`` and ``answer_seq``, the order in
    which answers came; of several usable answers to one text the first counts.
    Postings with the same text share one answer, so both sides meet on the hash
    of the text.
    """
    parsed = answers.select("text_hash", "answer_seq", parse_answer(F.col("content"), cfg).alias("_answer")).where(
        F.col("_answer").isNotNull()
    )
    usable = parsed.groupBy("text_hash").agg(F.min_by("_answer", "answer_seq").alias("_answer"))
    return (
        extracted.join(usable, "text_hash", "left")
        .withColumn("from_answer", F.col("_answer").isNotNull())
        .withColumn("skills", F.coalesce("_answer", "skills"))
        .drop("_answer")
    )


def text_hash() -> Column:
    text = F.concat_ws(" ", blank_if_null(F.col("title")), blank_if_null(F.col("description")))
    return F.md5(strip(text))
