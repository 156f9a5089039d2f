from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tidelog-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def make_log(spark):
    """Build a log from ``(stream, ms[, seq])`` rows in arrival order."""
    from tidelog.schema import MESSAGE_LOG

    def build(rows, recording="r", fields=None, step=1):
        full = [
            (
                row[0],
                row[1],
                row[2] if len(row) > 2 else 0,
                (fields[i] if fields else {"n": str(i)}),
                row[3] if len(row) > 3 else recording,
                i * step,
            )
            for i, row in enumerate(rows)
        ]
        return spark.createDataFrame(full, MESSAGE_LOG)

    return build


@pytest.fixture(scope="session")
def sample(make_log):
    """Seven messages of three streams; times count from ``START``."""
    from readings import READINGS, START

    return make_log(
        [(stream, START + ms) for stream, ms, _ in READINGS],
        fields=[fields for _, _, fields in READINGS],
    )


@pytest.fixture(scope="session")
def empty_log(spark):
    from tidelog.schema import MESSAGE_LOG

    return spark.createDataFrame([], MESSAGE_LOG)


@pytest.fixture
def in_zone(spark):
    """Run with another session time zone."""
    before = spark.conf.get("spark.sql.session.timeZone")
    yield lambda zone: spark.conf.set("spark.sql.session.timeZone", zone)
    spark.conf.set("spark.sql.session.timeZone", before)
