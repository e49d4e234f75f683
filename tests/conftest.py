import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
DATA = "/root/testdata/sf0.001"
#: Larger tables, on which rounding ties and the like are seen.
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessella.session import build_session

    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def value(x):
    """A cell in a form that two engines share: numbers to five digits, whole ones as integers."""
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
        return None
    if isinstance(x, float):
        x = round(x, 5)
        return str(int(x)) if x.is_integer() else x
    return str(x)


def canonical(frame):
    return sorted((tuple(map(value, row)) for row in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


def duck_on(folder):
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


@pytest.fixture(scope="session")
def duck():
    return {folder: duck_on(folder) for folder in (DATA, LARGER)}


@pytest.fixture
def agree(spark, duck):
    """Asserts that a query and its SQL give the same rows."""

    def check(function, sql, folder=DATA):
        ours, theirs = function(spark, folder).toPandas(), duck[folder].execute(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert len(ours) == len(theirs)
        assert canonical(ours) == canonical(theirs)

    return check
