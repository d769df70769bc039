import os

import pytest
from pyspark.sql import SparkSession

from tests import parity

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small_dir() -> str:
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(small_dir):
    return parity.connect(small_dir)
