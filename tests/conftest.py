import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def apply(spark):
    """Run a Column function over a list of texts."""
    from pyspark.sql import functions as F

    def run(step, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
        rows = df.select("id", step(F.col("text")).alias("out")).collect()
        return [r.out for r in sorted(rows, key=lambda r: r.id)]

    return run
