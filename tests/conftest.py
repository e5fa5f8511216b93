import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SMALL = pathlib.Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from foldwright.session import local_session

    return local_session("tests", "8", 4)


@pytest.fixture(scope="session")
def sf_dir():
    if not SMALL.exists():
        pytest.skip("the driver's tables are not here")
    return str(SMALL)
