"""Every core query with SQL gives the SQL's rows; the others run with a stable schema."""

import os

import pytest
from oracle import database, differences

from sarafa.plans import core, evidence, figures, portfolio, rules, texts

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODULES = (core, portfolio, figures, texts, evidence, rules)
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
ORACLES = {n: q for m in MODULES for n, q in m.ORACLES.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert differences([tuple(r) for r in df.collect()], df.columns, con, ORACLES[name])[:3] == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() >= 0


def test_names_and_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
