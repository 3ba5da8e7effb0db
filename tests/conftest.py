import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tenantlake.session import build_session  # noqa: E402
from tenantlake.streaming.logins import STATE_STORE  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[8]", shuffle_partitions=4,
        **{k.replace(".", "__"): v for k, v in STATE_STORE.items()},
        spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
