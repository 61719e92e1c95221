import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from crx.plans.session import get_session
    s = get_session(master="local[*]", shuffle_partitions=8, app_name="crx-tests")
    yield s


@pytest.fixture(scope="session")
def duck_small():
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    from oracle_check import duck
    return duck(SMALL)
