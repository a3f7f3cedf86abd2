import pytest

from kicknet.plans.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4, memory="8g")
    yield session
    session.stop()
