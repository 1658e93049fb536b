import pytest

from strandmill import session


@pytest.fixture(scope="session")
def spark():
    return session.build("tests", partitions=4)
