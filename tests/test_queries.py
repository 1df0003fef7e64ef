"""Every registered query of the library against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidemark import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def _cell(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return None
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def _rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, (tuple(_cell(v) for v in r) for r in df[cols].itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert _rows(catalog.QUERIES[name](spark, str(DATA)).toPandas()) == _rows(db.execute(catalog.ORACLES[name]).df())
