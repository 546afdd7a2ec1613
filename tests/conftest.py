from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from meteoqc.session import tuned

    s = tuned(SparkSession.builder.master("local[8]").appName("tests"), partitions=4).config(
        "spark.checkpoint.dir", str(tmp_path_factory.mktemp("stage"))).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def obs(spark, sf):
    from meteoqc.sources.tables import observations

    return observations(spark, sf).cache()
