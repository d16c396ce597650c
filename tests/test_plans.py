"""What the plans of the core queries must and must not contain."""

import os
import re

import pytest

from sarafa.plans import core, evidence, figures, portfolio, texts

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {n: q for m in (core, portfolio, figures, texts, evidence) for n, q in m.QUERIES.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_and_no_row_udfs(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|Join Cross", text)


def test_columns_are_pruned_and_filters_pushed(spark):
    text = plan(portfolio.q03_sector_weights(spark, FOLDER))
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert scans and not any(c in s for s in scans for c in ("l_tax", "l_shipdate", "p_brand", "p_name"))
    assert "PushedFilters: [IsNotNull(p_size)" in text or "LessThanOrEqual(p_size,45)" in text
    assert "title" not in re.findall(r"ReadSchema: struct<([^>]*)>", plan(texts.q27_event_actions(spark, FOLDER)))[0]


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(texts.q48_dedup_sort_cap(spark, FOLDER))
