"""Plan checks: no pair-generating joins, and no Python in the relational
sections (diffs, responses, context, events, dashboards, reports)."""

import re

import pytest

from crx.plans.registry import QUERIES, load_all

load_all()
SMALL = "/root/testdata/sf0.001"
PY_NODES = re.compile(r"MapInPandas|MapInArrow|ArrowEvalPython|BatchEvalPython|PythonUDF|FlatMapGroupsInPandas")
PAIR_JOINS = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin")

# Queries that run Python by design: the syntax-node scan (standard-library
# parser per file), the user scorer, and the greedy dedup, whose decisions
# depend on the ones before.
PYTHON_BY_DESIGN = {"code_nodes", "parse_status", "structure_summary", "rule_scan", "analyzer_dispatch",
                    "register_extractor", "score_with", "dedup_findings", "process_findings", "finding_stats",
                    "finalize_reviews", "high_risk_files", "review_summary", "review_pipeline"}


def _plan(spark, key):
    df = QUERIES[key](spark, SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_plan_shape(spark, key):
    p = _plan(spark, key)
    assert not PAIR_JOINS.search(p), f"{key} pairs rows:\n{p[:2000]}"
    if key not in PYTHON_BY_DESIGN and not key.startswith(("rule_py_", "py_")):
        assert not PY_NODES.search(p), f"{key} runs Python:\n{p[:2000]}"
