import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from graphloom.session import local_session

    session = local_session(cores=8, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
