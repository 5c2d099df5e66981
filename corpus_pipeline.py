"""The corpus pipeline: documents -> identified, filtered, de-duplicated, masked, packed.

Each stage takes all rows that the one before kept. A stage that drops rows works
on slim columns and marks a row by its id and a 64-bit hash of its text and source; the
whole rows are joined with the marks of those that stay. Rows alike in all are repeated
rows: a filter treats them alike, de-duplication leaves one.

Cases: see the operators. A null text has no letter and goes in the first stage;
other null columns are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirescope.llm import langid, neardup, packing, pii, quality
from hirescope.llm.common import table
from hirescope.session import materialize

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None
_MARK = ["_id", "_hash"]


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _hash() -> Column:
    return F.xxhash64("text", "source", F.col("doc_id").isNull(), F.col("text").isNull(), F.col("source").isNull())


def _staying(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` marked in ``kept`` (doc_id, tag), which is written first so that its size is known."""
    marks = materialize(kept.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("tag").alias("_hash")).distinct(), "marks")
    marked = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_hash": _hash()})
    return marked.join(marks, _MARK, "left_semi")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs, trees, out=("_language", "_share"))
    return found.where("_language <> 'und'").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judge(docs.withColumn("_tag", _hash()), tag="_tag")
    return _staying(docs, judged.where("kept")).select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(docs.withColumn("_tag", _hash()), tag="_tag")
    staying = _staying(docs, found.where("row = class_row"))
    # Repeated rows have one mark; of those, the first by the other columns stays. The join has them together.
    alike = Window.partitionBy(*_MARK).orderBy("source", "lang", "n_chars")
    return staying.withColumn("_nth", F.row_number().over(alike)).where("_nth = 1").select(docs.columns)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.scan(docs, out=("_spans", "_masked"))
    return masked.withColumns({"text": F.col("_masked"), "n_chars": F.length("_masked").cast("long")}).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, _vocabulary()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("pii", mask_pii),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return stage_of("best_fit_packing")(spark, docs, sf_dir)


def stage_of(name: str):
    return dict(STAGES)[name]
