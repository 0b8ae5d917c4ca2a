import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from retrieva.session import build_session, checkpoint_root
    s = build_session("local[4]", 8)
    checkpoint_root(s)
    yield s
    s.stop()
