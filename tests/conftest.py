import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("BENCH_CPUS", "8")


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local

    s = local()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
