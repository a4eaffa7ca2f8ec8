import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lodestitch.session import local_session

    session = local_session(8, 8, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "llm"))
