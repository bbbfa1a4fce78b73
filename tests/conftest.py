import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gatewise.session import build_session, drop_stages  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_stages(session)
    session.stop()


@pytest.fixture
def split_ordered_work(monkeypatch):
    """Force the bucketed path of ordered operators, which small data would not take."""
    from gatewise.operators import windows
    monkeypatch.setattr(windows, "BUCKET_ROWS", 3)
