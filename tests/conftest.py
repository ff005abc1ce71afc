import pytest

from quillspark.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", "3g")
    yield s
    s.stop()
