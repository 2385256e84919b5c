import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panewise.session import local_session  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", app="panewise-tests", memory="8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_small():
    path = f"{TESTDATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path


@pytest.fixture(scope="session")
def sf_medium():
    path = f"{TESTDATA}/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path
