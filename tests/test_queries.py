"""Every query with SQL equals DuckDB on the smallest tables, where they are there; the others run."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from vectide.queries import ORACLES, QUERIES

DATA = Path(os.environ.get("VECTIDE_TESTDATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not isinstance(v, (float, int)) and getattr(v, "ndim", 0):
        return tuple(plain(x) for x in v)
    if v is None or pd.isna(v):
        return None
    if isinstance(v, (bool,)) or type(v).__name__ == "bool":
        return bool(v)
    return f"{float(v):.9g}" if isinstance(v, (int, float)) or type(v).__module__ == "numpy" and type(v).__name__.startswith(("int", "float")) else str(v)


def rows(df: pd.DataFrame) -> list:
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name: str) -> None:
    got = QUERIES[name](spark, str(DATA)).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
