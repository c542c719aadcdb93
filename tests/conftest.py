import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ringledger.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(4, "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__execution__arrow__maxRecordsPerBatch="2000")
    yield s
    s.stop()
