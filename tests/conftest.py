import os
import sys
import tempfile
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from driftline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "driftline-tests", master="local[8]", shuffle_partitions=8,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.checkpoint.dir": tempfile.mkdtemp(prefix="driftline-tests-")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def at():
    """A date column value from text."""
    return datetime.fromisoformat
