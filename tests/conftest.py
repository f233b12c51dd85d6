import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *os.environ.get("PYTHONPATH", "").split(os.pathsep)]).rstrip(os.pathsep)

import pytest

from loomlake.session import local

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local(4, 4, "4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c
