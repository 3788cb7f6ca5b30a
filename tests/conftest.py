import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from slotwise.session import RECOMMENDED_CONF
    b = (SparkSession.builder.master("local[8]").appName("tests").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "8g"))
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
