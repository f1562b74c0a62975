import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from cohortlens.session import get_session
    s = get_session("local[4]", 4, app_name="cohortlens-tests")
    yield s
    s.stop()
