import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from talus.session import session

    root = tmp_path_factory.mktemp("spark")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": f"{root}/warehouse", "spark.checkpoint.dir": f"{root}/shared", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    s = session("local[4]", **conf)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
