"""Every named query against its SQL on the smallest tables, and the flagship query."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import check_oracles

import __spark_entry__ as entry_module
from tagloom.plans.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="tables are not here")


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


@needs_tables
def test_flagship(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 25 and {r["rank"] for r in rows} == set(range(1, 26))


@pytest.fixture(scope="module")
def db():
    return check_oracles.connect(SF_DIR)


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    run, sql = entry_module.queries()[name], entry_module.oracle_sql()[name]
    assert check_oracles.compare(spark, db, SF_DIR, name, run, sql) is None
