import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from vantage.session import session

    spark = session("local[4]", 4, spark__ui__showConsoleProgress="false", spark__driver__memory="3g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
