import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cohortspark.session import build_session

    session = build_session("tests", "local[8]", 4, {"spark.driver.memory": "8g", "spark.sql.warehouse.dir": "/tmp/cohortspark-warehouse"})
    session.sparkContext.setLogLevel("ERROR")
    return session
