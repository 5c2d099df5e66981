"""Queries that run as streams over the driver tables until all input is taken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirescope.operators.skills import extract_skills
from hirescope.operators.store import read_table
from hirescope.schemas import ARRIVAL, LONG, STRING, STRINGS, TIME, struct
from hirescope.session import scratch_path
from hirescope.streaming import counts, ingest, logs
from workloads import inputs as I
from workloads import oracle as O
from workloads.q_sources import UNION
from workloads.registry import register, seconds

CFG = I.CFG


def documents_stream(spark, sf) -> DataFrame:
    """The table as a stream, whether it is one file or a folder of parts; a stream takes a single file by a pattern only."""
    schema = I.table(spark, sf, "documents").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{{documents.parquet}}")


def finish(query) -> None:
    query.awaitTermination()


BATCHES = 5
_SLICE = f"CAST(floor(doc_id / 5) AS BIGINT) % {BATCHES}"


def slice_rule(i: int, repeated: bool) -> str:
    """Rows of arrival ``i``; a third of the arrival before comes again where rows are ``repeated``."""
    again = f" OR ({_SLICE} = {i - 1} AND doc_id % 3 = 0)" if repeated and i else ""
    return f"({_SLICE} = {i}{again})"


def in_batches(spark, sf, start, repeated: bool = False) -> None:
    """Documents land in ``BATCHES`` arrivals that hold all of them; after each the stream is started and takes what is new."""
    docs, landed = I.table(spark, sf, "documents"), scratch_path(spark, "arrivals")
    for i in range(BATCHES):
        docs.where(slice_rule(i, repeated)).write.mode("append").parquet(landed)
        finish(start(spark.readStream.schema(docs.schema).parquet(landed)))


_STREAM_RAW = O.query(O.RAW, UNION, "x").split("\nx")[0].replace("WITH RECURSIVE ", "", 1).replace("WITH ", "", 1)
_RESULT = [
    _STREAM_RAW,
    f"junior AS (SELECT * REPLACE (CAST(posting_date AS TIMESTAMP) AS posting_date), {O.ROLE} AS role_category FROM all_boards "
    f"WHERE NOT {O.IRRELEVANT} AND NOT {O.SENIOR} AND {O.ROLE} IS NOT NULL AND {O.ENTRY})",
    *O.greedy("junior"), f"located AS (SELECT * FROM uniq WHERE {O.REACH})", O.parsed("located"), *O.validated("parsed"),
]


def run_ingest(spark, sf) -> str:
    """Two starts on the same checkpoint; the second finds nothing new."""
    root, checkpoint = scratch_path(spark, "store"), scratch_path(spark, "store-checkpoint")
    landing = I.as_landing(I.as_postings(documents_stream(spark, sf)))
    for _ in range(2):
        finish(ingest.ingest(landing, root, checkpoint, CFG))
    return root


@register("stream_ingest", O.query(*_RESULT, "SELECT CAST(ingest_seq AS VARCHAR) AS ingest_seq, source, external_id, title, role_category FROM checked WHERE len(reasons) = 0"))
def _(spark, sf):
    columns = struct(ingest_seq=ARRIVAL, source=STRING, external_id=STRING, title=STRING, role_category=STRING)
    jobs = read_table(spark, run_ingest(spark, sf), "jobs", columns)
    return jobs.withColumn("ingest_seq", F.col("ingest_seq").cast("string"))


@register(
    "stream_late",
    O.query(*_RESULT, "SELECT CAST(ingest_seq AS VARCHAR) AS ingest_seq, source, external_id, title FROM checked WHERE list_contains(reasons, 'too_old')"),
)
def _(spark, sf):
    columns = struct(ingest_seq=ARRIVAL, source=STRING, external_id=STRING, title=STRING, reasons=STRINGS)
    rejects = read_table(spark, run_ingest(spark, sf), "rejects", columns)
    return ingest.late_postings(rejects).drop("reasons").withColumn("ingest_seq", F.col("ingest_seq").cast("string"))


def _batched_result() -> list[str]:
    """As ``_RESULT``, with de-duplication inside each arrival."""
    tables = []
    for i in range(BATCHES):
        rule = slice_rule(i, True).replace("doc_id", "CAST(ingest_seq // 2147483648 AS BIGINT)")
        tables += [f"junior{i} AS (SELECT *, {i} AS b FROM junior WHERE {rule})", *O.greedy(f"junior{i}", f"uniq{i}")]
    together = " UNION ALL BY NAME ".join(f"SELECT * FROM uniq{i}" for i in range(BATCHES))
    return [*_RESULT[:2], *tables, f"uniq AS ({together})", *_RESULT[-4:]]


@register("stream_ingest_batches", O.query(
    *_batched_result(), "SELECT CAST(ingest_seq AS VARCHAR) AS ingest_seq, source, external_id, title, role_category, CAST(b AS VARCHAR) AS run_id "
    "FROM checked WHERE len(reasons) = 0 QUALIFY row_number() OVER (PARTITION BY source, external_id ORDER BY b, ingest_seq) = 1"))
def _(spark, sf):
    """Five arrivals with rows known from the one before; each key is stored by the first batch that has it valid."""
    root, checkpoint = scratch_path(spark, "store"), scratch_path(spark, "store-checkpoint")
    in_batches(spark, sf, lambda docs: ingest.ingest(I.as_landing(I.as_postings(docs)), root, checkpoint, CFG, extract_skills), repeated=True)
    columns = struct(ingest_seq=ARRIVAL, source=STRING, external_id=STRING, title=STRING, role_category=STRING, run_id=STRING)
    return read_table(spark, root, "jobs", columns).withColumn("ingest_seq", F.col("ingest_seq").cast("string"))


_AT = "1704067200000000 + (doc_id * 7919 % 259200) * 1000000"


def _kept_by_batch() -> list[str]:
    """Late rows and first rows, arrival by arrival: an arrival sees what earlier ones kept."""
    union = " UNION ALL ".join(
        f"(SELECT source, external_id, make_timestamp({_AT.replace('doc_id', 'ingest_seq')}) AS moment, {i} AS b FROM raw WHERE {slice_rule(i, True).replace('doc_id', 'ingest_seq')})"
        for i in range(BATCHES))
    out = [f"arr AS ({union})", "kept AS (SELECT source, external_id, moment, 0 AS b FROM arr WHERE FALSE)"]
    before = "kept"
    for i in range(BATCHES):
        out += [
            f"edge{i} AS (SELECT max(moment) - INTERVAL 36 HOUR AS edge FROM arr WHERE b < {i})",
            f"on{i} AS (SELECT arr.* FROM arr, edge{i} WHERE b = {i} AND (edge IS NULL OR moment >= edge))",
            f"first{i} AS (SELECT source, external_id, min(moment) AS moment, {i} AS b FROM on{i} o WHERE NOT EXISTS (SELECT 1 FROM {before} k, edge{i} "
            f"WHERE k.source = o.source AND k.external_id = o.external_id AND k.moment >= edge) GROUP BY source, external_id)",
            f"kept{i} AS ((SELECT * FROM {before}) UNION ALL (SELECT * FROM first{i}))",
        ]
        before = f"kept{i}"
    ontime = " UNION ALL ".join(f"(SELECT * FROM on{i})" for i in range(BATCHES))
    return [*out, f"ontime AS ({ontime})", f"firsts AS (SELECT * FROM {before})",
            "outputs AS ((SELECT 'late' AS kind, source, external_id, moment, 1 AS n FROM (SELECT * FROM arr EXCEPT ALL SELECT * FROM ontime)) "
            "UNION ALL (SELECT 'unique', source, external_id, moment, 1 FROM firsts) "
            "UNION ALL (SELECT 'repeats', source, external_id, moment, 1 FROM ontime) UNION ALL (SELECT 'repeats', source, external_id, moment, -1 FROM firsts))"]


@register("stream_dedup_late", O.query(
    O.RAW, *_kept_by_batch(), f"SELECT kind, source, external_id, {O.ts('moment')} AS landed_at, CAST(sum(n) AS BIGINT) AS n FROM outputs "
    "GROUP BY kind, source, external_id, landed_at HAVING sum(n) > 0"))
def _(spark, sf):
    """Every row of five arrivals in one of three outputs: kept, repeated, or behind the horizon."""
    root, checkpoint = scratch_path(spark, "dedup"), scratch_path(spark, "dedup-checkpoint")

    def start(docs):
        arrivals = I.as_postings(docs).select("source", "external_id", F.timestamp_micros(F.expr(_AT.replace("doc_id", "ingest_seq"))).alias("landed_at"))
        return ingest.dedup_to(arrivals, "landed_at", "36 hours", CFG, root, checkpoint)

    in_batches(spark, sf, start, repeated=True)
    columns = struct(source=STRING, external_id=STRING, landed_at=TIME)
    outputs = [logs.live(spark, root, kind, columns).withColumn("kind", F.lit(kind)) for kind in ("unique", "repeats", "late")]
    rows = outputs[0].unionByName(outputs[1]).unionByName(outputs[2])
    return rows.groupBy("kind", "source", "external_id", seconds("landed_at")).agg(F.count("*").alias("n"))


@register("stream_dedup", O.query(O.RAW, "SELECT DISTINCT source, external_id FROM raw"))
def _(spark, sf):
    path, checkpoint = scratch_path(spark, "dedup"), scratch_path(spark, "dedup-checkpoint")
    arrivals = I.as_postings(documents_stream(spark, sf)).select(
        "source", "external_id", F.timestamp_micros(F.lit(1704067200000000) + F.col("ingest_seq") * 1000).alias("landed_at")
    )
    unique = ingest.dedup_stream(arrivals, "landed_at", "30 days", CFG).select("source", "external_id")
    finish(
        unique.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    return spark.read.schema(unique.schema).parquet(path)


_DATED = f"dated AS (SELECT posting_date AS d, {O.ROLE} AS role_category FROM raw WHERE posting_date IS NOT NULL)"
_WINDOW = struct(window_start=TIME, window_end=TIME, role_category=STRING, n=LONG)


def _windows(spark, sf, length: str, slide: str | None) -> DataFrame:
    """Counted over five arrivals."""
    path, checkpoint = scratch_path(spark, "windows"), scratch_path(spark, "windows-checkpoint")
    in_batches(spark, sf, lambda docs: counts.write_updates(counts.windowed_counts(I.as_postings(docs), CFG, length, slide), path, checkpoint))
    latest = counts.latest_counts(spark, path, _WINDOW)
    return latest.withColumns({"window_start": seconds("window_start"), "window_end": seconds("window_end")})


def _window_sql(slide_days: int) -> str:
    starts = f"(epoch_us(d) // 86400000000 // {slide_days}) * {slide_days}"
    return (
        f"SELECT strftime(make_timestamp(s * 86400000000), '%Y-%m-%d %H:%M:%S') AS window_start, "
        "strftime(make_timestamp((s + 7) * 86400000000), '%Y-%m-%d %H:%M:%S') AS window_end, role_category, count(*) AS n "
        f"FROM (SELECT role_category, unnest(range(CAST({starts} AS BIGINT) - 7 + {slide_days}, CAST({starts} AS BIGINT) + 1, {slide_days})) AS s FROM dated) GROUP BY ALL"
    )


@register("stream_hiring_tumbling", O.query(O.RAW, _DATED, _window_sql(7)))
def _(spark, sf):
    return _windows(spark, sf, "7 days", None)


@register("stream_hiring_sliding", O.query(O.RAW, _DATED, _window_sql(1)))
def _(spark, sf):
    return _windows(spark, sf, "7 days", "1 day")


@register("stream_skill_demand", O.query(O.RAW, *O.skills("raw"), "SELECT skill, count(*) AS n FROM hits GROUP BY skill"))
def _(spark, sf):
    path, checkpoint = scratch_path(spark, "demand"), scratch_path(spark, "demand-checkpoint")
    stream = counts.skill_counts(I.as_postings(documents_stream(spark, sf)), CFG)
    finish(counts.write_updates(stream, path, checkpoint))
    return counts.latest_counts(spark, path, struct(skill=STRING, n=LONG))


def _late_sql() -> list[str]:
    rows = " UNION ALL ".join(f"(SELECT posting_date AS d, {O.ROLE} AS role_category, {i} AS b FROM raw "
                              f"WHERE posting_date IS NOT NULL AND {slice_rule(i, False).replace('doc_id', 'ingest_seq')})"
                              for i in range(BATCHES))
    edges = " UNION ALL ".join(f"(SELECT {i} AS b, max(d) - INTERVAL 30 DAY AS edge FROM arr WHERE b < {i})" for i in range(BATCHES))
    return [f"arr AS ({rows})", f"edges AS ({edges})", "judged AS (SELECT arr.*, coalesce(d < edge, FALSE) AS late FROM arr JOIN edges USING (b))",
            "dated AS (SELECT d, role_category FROM judged WHERE NOT late)"]


@register("stream_hiring_late", O.query(
    O.RAW, *_late_sql(), f"counted AS ({_window_sql(7)})",
    "SELECT * FROM counted UNION ALL BY NAME SELECT 'late' AS window_start, 'late' AS window_end, role_category, count(*) AS n FROM judged WHERE late GROUP BY role_category"))
def _(spark, sf):
    """Counts of five arrivals within 30 days, and how many rows were later: together all dated rows."""
    root, checkpoint = scratch_path(spark, "windows"), scratch_path(spark, "windows-checkpoint")
    in_batches(spark, sf, lambda docs: counts.count_windows(I.as_postings(docs), CFG, "7 days", None, "30 days", root, checkpoint))
    counted = counts.counted_windows(spark, root).withColumns({"window_start": seconds("window_start"), "window_end": seconds("window_end")})
    late = logs.live(spark, root, "late", struct(role_category=STRING)).groupBy("role_category").agg(F.count("*").alias("n"))
    return counted.unionByName(late.withColumns({"window_start": F.lit("late"), "window_end": F.lit("late")}))


@register("stream_skill_demand_batches", O.query(O.RAW, *O.skills("raw"), "SELECT skill, count(*) AS n FROM hits GROUP BY skill"))
def _(spark, sf):
    """Skill demand over five arrivals, read from its merged log."""
    path, checkpoint = scratch_path(spark, "demand"), scratch_path(spark, "demand-checkpoint")
    in_batches(spark, sf, lambda docs: counts.write_updates(counts.skill_counts(I.as_postings(docs), CFG), path, checkpoint))
    return counts.latest_counts(spark, path, struct(skill=STRING, n=LONG))
