import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from weftlake.session import session

    s = session("local[4]", 4, spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB over sf0.001, with the driver's views."""
    import duckdb

    con = duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def same_rows(got, expected) -> None:
    """Compare two Arrow tables as multisets, doubles to nine digits."""
    cols = sorted(got.column_names)
    assert cols == sorted(expected.column_names)
    text = lambda v: "null" if v is None else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    rows = lambda t: sorted(zip(*[[text(v) for v in t.column(c).to_pylist()] for c in cols]))
    assert rows(got) == rows(expected)
