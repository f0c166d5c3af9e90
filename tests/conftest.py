import pytest

from wardline.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, "4g", "wardline-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
