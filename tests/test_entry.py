"""Registered queries at the smallest scale against their SQL twins (a fast selection)."""

import pytest

import __spark_entry__ as entry
from check import compare, connect

FAST = ["exact_dedup", "line_verdict", "page_status", "identifier_index", "bm25_topk", "dense_topk", "scope_gate",
        "daily_usage", "cap_admission", "pathway_route", "category_stats"]


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, sf, name):
    assert compare(entry.queries()[name](spark, sf).toPandas(), connect(sf).execute(entry.oracle_sql()[name]).df()) == ""
