"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry

from .compare import ROOT, difference

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        text, _ = difference(spark, QUERIES[name], ORACLES[name], ROOT + "0.001")
        assert text == ""
    else:
        assert QUERIES[name](spark, ROOT + "0.001").columns


# Means and ratios, where another size of the tables can round differently.
@pytest.mark.parametrize("scale", ["0.01", "0.1"])
@pytest.mark.parametrize("name", ["contest_config_matrix", "stats_min_median_mean", "contest_ratio_summary"])
def test_float_query_at_larger_scale(spark, name, scale):
    text, _ = difference(spark, QUERIES[name], ORACLES[name], ROOT + scale)
    assert text == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
