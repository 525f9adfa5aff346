import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from storelens.session import configure, release  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("storelens-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def star_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def star(spark, star_dir):
    from storelens.sources.star import commerce_tables

    return commerce_tables(spark, star_dir)
