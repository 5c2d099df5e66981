"""From the landing table to postings, for one board or for all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirescope.config import Config
from hirescope.functions.stats import top_per_group
from hirescope.functions.text import fingerprint
from hirescope.schemas import ARRIVAL, POSTING_FIELDS
from hirescope.session import keep_listed, scratch_path
from hirescope.sources.registry import SOURCES, Source


# More than any place inside a payload (a place is an INT).
_ROOM = 1 << 31
_NO_BOARD = "no board"


def _arrival(position: Column) -> Column:
    """Arrival number of a record: the payload's number, then the place inside the payload.

    A decimal holds both for every payload number and every place, in order.
    """
    number = F.col("ingest_seq").cast("decimal(19,0)") * F.lit(_ROOM).cast("decimal(10,0)")
    return (number + position.cast("decimal(10,0)")).cast(ARRIVAL).alias("ingest_seq")


def _flat() -> list[Column]:
    """Posting fields; where a board sets no raw data of its own, that is the payload as it came."""
    own = F.col("posting.raw_data")
    fields = [F.col(f"posting.{n}").alias(n) for n in POSTING_FIELDS.names if n != "raw_data"]
    return [*fields, F.coalesce(own, F.col("payload")).alias("raw_data"), F.col("ingest_seq")]


def map_source(landing: DataFrame, source: str | Source, cfg: Config) -> DataFrame:
    """Postings of one board. Reads only that board's folder if landing is partitioned by source."""
    board = SOURCES[source] if isinstance(source, str) else source
    return (
        landing.where(F.col("source") == board.name)
        .select("ingest_seq", "context", "payload", F.posexplode_outer(board.records(F.col("payload"))).alias("pos", "record"))
        .select(_arrival(F.col("pos")), "payload", board.posting(F.col("record"), F.col("context"), cfg).alias("posting"))
        .where(F.col("posting").isNotNull())
        .select(*_flat())
    )


def _boards(boards: list[str] | None) -> list[Source]:
    return [SOURCES[b] for b in boards] if boards else list(SOURCES.values())


def union_sources(landing: DataFrame, cfg: Config, boards: list[str] | None = None) -> DataFrame:
    """Postings of every board: one branch per board, which reads only that board's folder if
    landing is partitioned by source, and maps its records by compiled expressions.

    A payload that cannot be read yields nothing and disturbs no other row;
    :func:`quarantined` returns those payloads.
    """
    branches = [map_source(landing, board, cfg) for board in _boards(boards)]
    return reduce(DataFrame.unionByName, branches)


def written_by_board(landing: DataFrame, boards: list[str] | None = None) -> DataFrame:
    """``landing`` written once, a folder per board (column ``board``) and one for all other sources.

    Every branch of :func:`map_landing` works out its whole input, which of a micro-batch no filter
    reaches into; of a table in folders it reads its own.
    """
    spark, path = landing.sparkSession, scratch_path(landing.sparkSession, "landed")
    known = F.col("source").isin([b.name for b in _boards(boards)])
    landed = landing.withColumn("board", F.when(known, F.col("source")).otherwise(_NO_BOARD))
    landed.write.partitionBy("board").parquet(path)
    return spark.read.schema(landed.schema).parquet(path)


def map_landing(landing: DataFrame, cfg: Config, boards: list[str] | None = None) -> DataFrame:
    """Every record of every payload once: the posting's fields, where it came from (``landed_seq``,
    ``landed_source``) and whether it is ``usable``. ``landing`` may come from :func:`written_by_board` for the same boards.

    Write it, and both :func:`usable_postings` and :func:`unreadable_payloads` come from one parse.
    """
    chosen = _boards(boards)
    source = F.col("board" if "board" in landing.columns else "source")
    known = F.coalesce(source.isin([b.name for b in chosen]), F.lit(False))
    came = [F.col("ingest_seq").alias("landed_seq"), F.col("source").alias("landed_source")]

    def rows(records: DataFrame) -> DataFrame:
        usable = F.col("posting").isNotNull()
        fields = [F.when(usable, c).alias(n) for n, c in zip(POSTING_FIELDS.names, _posting_columns())]
        return records.select("landed_seq", "landed_source", usable.alias("usable"), *fields, "ingest_seq")

    branches = [
        rows(landing.where(source == board.name)
             .select(*came, "ingest_seq", "context", "payload", F.posexplode_outer(board.records(F.col("payload"))).alias("pos", "record"))
             .select("landed_seq", "landed_source", "payload", _arrival(F.coalesce("pos", F.lit(0))),
                     board.posting(F.col("record"), F.col("context"), cfg).alias("posting")))
        for board in chosen
    ]
    nothing = F.lit(None).cast(branches[0].select([F.struct(*POSTING_FIELDS.names).alias("p")]).schema["p"].dataType)
    strange = landing.where(~known).select(*came, "payload", _arrival(F.lit(0)), nothing.alias("posting"))
    return reduce(DataFrame.unionByName, [*branches, rows(strange)])


def _posting_columns() -> list[Column]:
    own = F.coalesce(F.col("posting.raw_data"), F.col("payload"))
    return [own if n == "raw_data" else F.col(f"posting.{n}") for n in POSTING_FIELDS.names]


def usable_postings(mapped: DataFrame) -> DataFrame:
    return mapped.where("usable").select(*POSTING_FIELDS.names, "ingest_seq")


def unreadable_payloads(mapped: DataFrame) -> DataFrame:
    """(ingest_seq, source) of payloads without a usable record, and of no known board."""
    of_some = mapped.where("NOT usable").select(F.col("landed_seq").alias("ingest_seq"), F.col("landed_source").alias("source")).distinct()
    used = mapped.where("usable").select(F.col("landed_seq").alias("ingest_seq"))
    return of_some.join(used, "ingest_seq", "left_anti")


def _usable(board: Source, cfg: Config) -> Column:
    found = F.exists(board.records(F.col("payload")), lambda r: board.posting(r, F.col("context"), cfg).isNotNull())
    return F.coalesce(found, F.lit(False))


def quarantined(landing: DataFrame, cfg: Config, boards: list[str] | None = None) -> DataFrame:
    """Payloads without a usable record, and payloads of no known board."""
    chosen = _boards(boards)
    known = F.coalesce(F.col("source").isin([b.name for b in chosen]), F.lit(False))
    out = landing.where(~known)
    for board in chosen:
        out = out.unionByName(landing.where((F.col("source") == board.name) & ~_usable(board, cfg)))
    return out


def dedup_and_cap(postings: DataFrame, cfg: Config) -> DataFrame:
    """First posting per fingerprint; boards in ``cfg.source_caps`` keep their first N, others keep all.

    No board has a cap by default. The cap is a property of the board's crawl, so it only counts distinct
    postings. Rows are first reduced to keys; uncapped boards never enter the
    ranking, so a board holding most of the rows costs nothing there.
    """
    keyed = postings.withColumn("fingerprint", fingerprint(F.col("source"), F.col("external_id")))
    firsts = keyed.groupBy("fingerprint", "source").agg(F.min("ingest_seq").alias("ingest_seq"))
    if not cfg.source_caps:
        return keep_listed(keyed, firsts, "ingest_seq", "first-postings")
    capped_sources = list(cfg.source_caps)
    largest = max(cfg.source_caps.values(), default=0)
    limits = F.create_map(*[F.lit(x) for pair in cfg.source_caps.items() for x in pair])
    ranked = top_per_group(
        firsts.where(F.col("source").isin(capped_sources)),
        ["source"], largest, [F.asc("ingest_seq"), F.asc("fingerprint")],
    ).where(F.col("rank") <= F.try_element_at(limits, F.col("source")))
    free = firsts.where(~F.col("source").isin(capped_sources))
    kept = ranked.select("ingest_seq").unionByName(free.select("ingest_seq"))
    return keep_listed(keyed, kept, "ingest_seq", "over-cap")
