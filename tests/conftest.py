import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomwork.session import create  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = create("local[4]", 4, "4g")
    yield session
    session.stop()
