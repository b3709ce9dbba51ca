from __future__ import annotations

import pytest

from corpusflow.plans import registry

registry.load()


@pytest.mark.parametrize("name", ["val_notemark", "val_run_all"])
def test_plan_stays_small(spark, name):
    """Each use of a table is planned anew: over tables that are not written, the plan grew until Catalyst failed on it."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\n") < 400


def test_all_parts_are_counted(spark):
    counts = {(r.rule_id, r.severity): r.n for r in registry.QUERIES["val_run_all"](spark, "/root/testdata/sf0.001").collect()}
    for name in ("val_notemark", "val_sdm", "val_monospace"):
        for r in registry.QUERIES[name](spark, "/root/testdata/sf0.001").groupBy("rule_id", "severity").count().collect():
            assert counts[r.rule_id, r.severity] >= r["count"] > 0
