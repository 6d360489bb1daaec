import pytest

from vigilake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cpus=4, shuffle=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
