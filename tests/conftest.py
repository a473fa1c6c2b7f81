import pytest

from keyfold.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("keyfold-tests", cpus=8, shuffle_partitions=8)
    yield session
    session.stop()
