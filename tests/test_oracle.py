"""Every registered query against its SQL on the small tables; queries without SQL must give rows."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from tabwise.plans.catalog import QUERIES, SQL

HEAVY = {"m4_regression", "m5_classification", "m6_permutation_importance", "m17_what_if", "m10_segments", "m11_segment_features", "m18_resegment", "t11_kmeans", "t13_driver_importances", "m12_projection"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_matches_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, SQL[name]) == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL and n not in HEAVY])
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
