import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from tidegrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", "local[4]", 4)
