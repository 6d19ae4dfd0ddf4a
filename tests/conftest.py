import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cytogrid.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "cytogrid-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
