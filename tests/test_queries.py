"""Every core query runs, and matches its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quadloom.plans import registry

# long ones and iterative ones are covered by their own tests
SLOW = {"mtx7_merge_sweep", "mtx8_grouping_fixpoint"}
NAMES = [n for n in registry.queries() if n not in SLOW]


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    null = lambda v: v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v)
    for c in df.columns:
        df[c] = df[c].map(lambda v: "~" if null(v) else f"{v:.6g}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf, name):
    got = registry.queries()[name](spark, sf).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) > 0
        return
    exp = duck.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(exp.columns)
    pd.testing.assert_frame_equal(canon(got), canon(exp))


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "agg2_frame_info" in e.queries()


def test_names_are_listed_without_a_session():
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[1])
    assert out.returncode == 0, out.stderr
