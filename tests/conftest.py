import pytest

from tallymill.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "4g")
    ship(s)
    yield s
    s.stop()
