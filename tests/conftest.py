import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("CELLWEFT_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from cellweft.session import get_session

    s = get_session("tests", os.environ.get("CELLWEFT_MASTER", "local[8]"), spark__sql__shuffle__partitions="8", spark__driver__memory="6g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return lambda size: f"{DATA}/sf{size}"
