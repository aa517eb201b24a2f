import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '8')}]")
        .appName("stopflow-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_limits(spark):
    """Make groups of 20 rows heavy and forbid broadcasts above 5 rows."""
    spark.conf.set("stopflow.hotGroupRows", "20")
    spark.conf.set("stopflow.broadcastRows", "5")
    yield
    spark.conf.unset("stopflow.hotGroupRows")
    spark.conf.unset("stopflow.broadcastRows")
