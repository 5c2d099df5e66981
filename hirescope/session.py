"""Session settings and the one place that decides where intermediate tables go."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Bytes and rows of one Arrow batch; a task holds a few batches of texts, never its whole split.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4096


def build_session(app_name: str = "hirescope", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Recording a stack trace per expression doubles the time to build wide plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare_workers(spark: SparkSession) -> SparkSession:
    """Bounded Arrow batches, and a path on which Python workers find this package.

    Where executors are other machines, install the package there or pass it with --py-files.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{known}".rstrip(":")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would lose its files with the executor that wrote them.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = _local_fallback()
    return configured.rstrip("/")


_FALLBACK: list[str] = []


def _local_fallback() -> str:
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="hirescope-"))
    return _FALLBACK[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/hirescope/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and lets several consumers read
    one result instead of recomputing it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for ``df``; nothing may read it any more."""
    path = df.__dict__.pop("_scratch", None) if df is not None else None
    if path:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def keep_listed(df: DataFrame, kept: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of a wide ``df`` whose unique ``key`` is in ``kept``.

    The numbers are written first, so their size is known when the join is
    planned: while it is under the session's broadcast limit the wide rows stay
    where they are, and only beyond it both sides are shuffled.
    """
    return df.join(materialize(kept.select(key), name), key, "left_semi")
