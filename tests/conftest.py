from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from dustledger.session import local_session

    session = local_session(4, 4, **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    yield session
    session.stop()
