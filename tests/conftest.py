import tempfile

import pytest

from callflow.session import local_session, prepare


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, 4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    return prepare(session)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-")
