import pytest

from phasewise.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("phasewise-tests", master="local[8]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
