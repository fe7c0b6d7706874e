import pytest
from pyspark.sql import SparkSession

from stridelake import build_session


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    s = build_session("tests", "local[8]", 8, spark__driver__memory="6g", spark__sql__autoBroadcastJoinThreshold="256k")
    s.sparkContext.setLogLevel("ERROR")
    return s
