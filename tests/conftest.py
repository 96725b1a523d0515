import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from casewright.session import build_session

    session = build_session(
        "local[2]", "tests", spark__sql__shuffle__partitions="3", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
