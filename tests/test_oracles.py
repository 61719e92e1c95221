"""Every registered query against its DuckDB oracle on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
import oracle_check  # noqa: E402

from crx.plans.registry import ORACLES, QUERIES, load_all  # noqa: E402

load_all()
SMALL = "/root/testdata/sf0.001"
KEYS = sorted(QUERIES)  # the training-data queries have their own tests


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck_small, key):
    oracle_check.SF = SMALL
    r = oracle_check.compare(spark, duck_small, key, QUERIES[key], ORACLES.get(key))
    if key in ORACLES:
        assert r["cols_match"], r
        assert r["rows"] == r["oracle_rows"], r
        assert r["values_match"], r
    else:
        assert r["rows"] >= 0


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "position" in df.columns
