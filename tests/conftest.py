import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assayline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Make a DataFrame from literal rows."""
    return lambda layout, *data: spark.createDataFrame(list(data), layout)


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    """Treat every table as too large to broadcast, in the library and in Spark."""
    from assayline.operators import lookups

    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 0)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, value in before.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)
