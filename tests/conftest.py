import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vacatlas.session import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def one(spark):
    """Values of an expression or operator over one column of texts, in order."""

    def run(values, column, operator, out):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"_i int, {column} string")
        return [row[out] for row in operator(rows).orderBy("_i").collect()]

    return run
