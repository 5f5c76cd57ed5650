import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from specaudit.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
