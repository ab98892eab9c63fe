"""Every query of the core against its SQL on the smallest test data, twice for the same rows; entry() has a stable schema."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from compare import canon  # noqa: E402

from callweave.plans import catalog, problems  # noqa: E402

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.QUERIES | problems.QUERIES, catalog.SQL | problems.SQL
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"acoustic_features"}))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).toPandas().columns.is_unique


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
