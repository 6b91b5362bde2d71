import pytest

from tessera.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4"})
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
