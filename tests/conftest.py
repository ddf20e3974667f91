import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from weekwatch.session import get_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", cores="8", shuffle=4)


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
