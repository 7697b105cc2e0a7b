import pytest

from tallygrove.session import local_session

SF = "/root/testdata/sf0.01"
TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 8, "4g")
    yield s


@pytest.fixture(scope="session")
def con():
    from tests.harness import duck

    return duck(TINY)
