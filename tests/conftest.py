import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from testfloor.session import build_session

    session = build_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
