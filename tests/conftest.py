import os

import pytest
from pyspark.sql import SparkSession

BASE = os.environ.get("LEMMARY_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lemmary.runtime import reach_workers

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    reach_workers(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def base():
    if not os.path.isdir(BASE):
        pytest.skip("test tables are not here")
    return BASE
