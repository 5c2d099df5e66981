"""What a run does not store, each row with its reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirescope.operators.normalize import unparseable
from hirescope.schemas import ARRIVAL, REJECTS, conform


def rejects(unreadable: DataFrame, found: DataFrame, checked: DataFrame) -> DataFrame:
    """``unreadable`` payloads (ingest_seq, source), unparseable rows of ``found`` and invalid rows of ``checked``.

    A payload's arrival number is that of its first record.
    """
    first = F.col("ingest_seq").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)")
    payloads = unreadable.select(
        first.cast(ARRIVAL).alias("ingest_seq"), "source", F.array(F.lit("unreadable_payload")).alias("reasons"))
    rows = unparseable(found).withColumn("reasons", F.array(F.lit("unparseable")))
    parts = [conform(df, REJECTS) for df in (payloads, rows, checked.where("NOT is_valid"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
