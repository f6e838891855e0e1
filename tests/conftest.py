import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    with tempfile.TemporaryDirectory() as tmp:
        session = (
            SparkSession.builder.master("local[4]").appName("tests")
            .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
            .config("spark.checkpoint.dir", f"file://{tmp}/shared").config("spark.sql.warehouse.dir", f"{tmp}/warehouse")
            .getOrCreate()
        )
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
