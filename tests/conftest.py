import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from readloom.session import build_session

    s = build_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    from readloom.sources.indexes import register

    register(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def normal(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, bytes | bytearray):
        return repr(bytes(v))
    return repr(v.replace(tzinfo=None)) if getattr(v, "tzinfo", None) else repr(v)


def rows(df):
    return sorted(tuple(r) for r in df.collect())
