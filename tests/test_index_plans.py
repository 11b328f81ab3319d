"""What routes into the index reads it as it was built and does not plan the build again."""

import pytest

from registrum import session
from registrum.operators import index as X
from registrum.plans import builds, catalogue  # noqa: F401

SF = "/root/testdata/sf0.001"
#: Most lines of the executed plan. Before the index was staged, the shortest of them, cap_per_file, had 212 on sf0.01.
MOST = {
    "cap_per_file": 100,
    "file_of_word": 100,
    "gap_causes": 100,
    "route_merged": 100,
    "route_typing": 100,
    "routing_grid": 100,
    "session_cost_summary": 100,
    "index_problems": 100,
    "pooled_quality": 100,
    "route_longest": 100,
    "route_paused": 100,
    "routed_search": 200,
    "session_costs": 100,
    "routing_table": 100,
}


@pytest.mark.parametrize("name", MOST)
def test_plan_is_short(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("\n") <= MOST[name]


#: What reads the routing table and nothing of the index.
ROUTED = ["route_typing", "routing_grid", "route_longest", "route_paused"]


@pytest.mark.parametrize("name", ROUTED)
def test_routing_builds_no_index(spark, monkeypatch, name):
    """Nothing is joined with prominence or ranked, and neither entries nor capped lists are written."""
    plans, write = {}, session.written

    def seen(df, table, *by):
        plans[table] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, table, *by)

    monkeypatch.setattr(session, "written", seen)
    catalogue.QUERIES[name](spark, SF)
    assert set(plans) == {"shards", "files", "bounds", "typed"}
    assert "p_retailprice" not in "".join(plans.values())


def test_full_files_are_those_that_cap_files_cuts(spark):
    entries = spark.createDataFrame([(f, e) for f, n in ((0, 2), (1, 3), (2, 4)) for e in range(n)] + [(1, None), (3, None)], "file int, lei long")
    entities = spark.createDataFrame([(e, e / 2) for e in range(4)], "lei long, prominence double")
    full = {r.file: r.capped for r in X.full_files(entries, 3).collect()}
    assert full == {0: False, 1: False, 2: True, 3: False}
    assert {(r.file, r.capped) for r in X.cap_files(entries, entities, 3).collect()} == {(f, c) for f, c in full.items() if f < 3}
