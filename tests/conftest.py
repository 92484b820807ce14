import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session

    session = build_session("tests", "local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "6g", "spark.cleaner.periodicGC.interval": "20s"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    from check_queries import duck_connection

    return duck_connection(FOLDER)


@pytest.fixture(scope="session")
def value(spark):
    """Value of a column function over each text, in order."""
    from pyspark.sql import functions as F

    def run(fn, texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
        return [r[1] for r in sorted(rows.select("i", fn(F.col("t")).alias("v")).collect())] if not texts else [
            r["v"] for r in sorted(rows.select("i", fn(F.col("t")).alias("v")).collect(), key=lambda r: r["i"])]

    return run
