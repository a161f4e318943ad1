import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from popspark.session import session

    s = session("tests", "local[8]", 4, **{"spark__ui__enabled": "false", "spark__driver__memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
