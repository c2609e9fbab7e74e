import pytest

from skyledger.session import local_session

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, partitions=4)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
