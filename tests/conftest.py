import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session, share_code

    session = build_session("tests", "local[4]", 4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="3g", spark__sql__adaptive__coalescePartitions__parallelismFirst="false")
    session.sparkContext.setLogLevel("ERROR")
    share_code(session)
    yield session
    session.stop()
