import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pulsegrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", 4)
    yield s
    s.stop()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
