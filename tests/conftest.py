import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from readmill.plans.runtime import session

    s = session("tests", 4, **{"spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def small():
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no supplied tables")
    return d
