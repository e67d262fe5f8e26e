import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from umbra.session import local_session

    os.environ.setdefault("UMBRA_DRIVER_MEMORY", "3g")
    s = local_session(4, 4, "umbra-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
