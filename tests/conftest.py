from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sourcegauge.session import local_session  # noqa: E402

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp")})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    return TABLES
