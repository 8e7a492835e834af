"""Every registered query against its SQL, on the smallest tables."""

import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))
SF = "/root/testdata/sf0.001"
pytest.importorskip("duckdb")
if not pathlib.Path(SF).is_dir():
    pytest.skip("no test tables", allow_module_level=True)

import __spark_entry__ as contract  # noqa: E402
import check  # noqa: E402


@pytest.fixture(scope="module")
def oracle():
    return check.oracle(SF)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, oracle, name):
    got = contract.queries()[name](spark, SF)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
        return
    want = oracle.sql(sql)
    assert check.type_gap(got, want) == ""
    assert check.compare(got.toPandas(), want.df()) == "ok"


def test_entry(spark):
    assert contract.entry(spark).count() > 0
