import pytest

from lodestone.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "tests")
    yield s
    s.stop()
