import pytest

from quadloom.runtime import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
