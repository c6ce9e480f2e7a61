import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from tidemill.session import local_session

    s = local_session("tests", cores=4, partitions=4)
    yield s
    s.stop()
