import os
import sys
from datetime import datetime, timezone

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hirescope.config import Config  # noqa: E402
from hirescope.schemas import POSTING_RAW, conform  # noqa: E402

AS_OF = datetime(2024, 1, 10, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cfg():
    return Config(as_of=AS_OF)


@pytest.fixture
def make(spark):
    """Postings from keyword rows; fields not given are null or their usual default."""

    def build(*rows):
        full = []
        for i, row in enumerate(rows):
            base = {"source": "t", "external_id": str(i), "ingest_seq": i, "employment_type": "unknown"}
            merged = {**base, **row}
            full.append(tuple(merged.get(f.name) for f in POSTING_RAW.fields))
        return conform(spark.createDataFrame(full, POSTING_RAW), POSTING_RAW)

    return build


def column(df, name, order="ingest_seq"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]
