import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tests.compare import session
    s = session(os.environ.get("TEST_CPUS", "8"))
    yield s
    s.stop()
