import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
# Python workers import the package as well.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])]
)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("papersieve-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def schema():
    from catalogue.sample_schema import SCHEMA

    return SCHEMA


@pytest.fixture
def replies(spark):
    """Rows of ``doc_id, file_name, has_text, response`` for a list of replies."""
    def make(*texts):
        rows = [(i, f"doc_{i}.pdf", True, text) for i, text in enumerate(texts)]
        return spark.createDataFrame(
            rows, "doc_id bigint, file_name string, has_text boolean, response string"
        )

    return make
