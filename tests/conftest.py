import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from layover.session import configured_dir, sweep, tune  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF = "/root/testdata/sf0.01"


def make_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("layover")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not configured_dir(spark):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="layover-tests-"))
    return tune(spark)


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    for table in session.catalog.listTables():
        if table.name.startswith("layover_"):
            session.sql(f"DROP TABLE IF EXISTS {table.name}")
    sweep(session)
