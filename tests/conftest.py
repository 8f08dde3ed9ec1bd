import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gaugeworks.session import local_session

    root = tmp_path_factory.mktemp("spark")
    session = local_session(
        4, "gaugeworks-tests",
        **{"spark.sql.warehouse.dir": str(root / "warehouse"),
           "spark.checkpoint.dir": str(root / "checkpoint"),
           "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def ts():
    from datetime import datetime, timezone

    def make(text):
        return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)

    return make
