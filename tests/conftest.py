import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quillmesh import runtime  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = runtime.build_session(4, 4, spark__sql__warehouse__dir="/tmp/quillmesh-warehouse")
    session.sparkContext.setLogLevel("ERROR")
    runtime.ship_package(session)
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
