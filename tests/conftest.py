import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from siltstone.session import local_session

    session = local_session("tests", 4, **{"spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared")), "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield session
    session.stop()
