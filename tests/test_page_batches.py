"""Pages that are grouped in Python share Arrow batches."""

from __future__ import annotations

import pytest

from quillframe.plans import registry


@pytest.mark.parametrize("name", ["text_blocks", "figure_clusters", "fragment_components"])
def test_no_call_a_group(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
