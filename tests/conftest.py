from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
for p in (ROOT, str(Path(__file__).resolve().parent)):
    if p not in sys.path:
        sys.path.insert(0, p)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))])

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from starledger.session import session

    s = session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
