"""No join of entities, queries or postings sends one side through the driver because its files are small."""

import re

import pytest

from registrum import session
from registrum.plans import builds, catalogue  # noqa: F401

SF = "/root/testdata/sf0.001"
#: Keys of tables that grow with the input (a distinct name's key, lei in features(), is no long and has no L).
GROWING = r"BroadcastHashJoin \[(?:lei#\d+L|session#|term#|word#)"
ROUTED = ["index_problems", "route_merged", "route_typing", "routing_grid", "session_cost_summary", "route_longest", "route_paused"]
SEARCHED = ["gap_causes", "pooled_quality", "routed_search"]


@pytest.mark.parametrize("name", ROUTED + SEARCHED)
def test_no_broadcast_by_file_size(spark, monkeypatch, name):
    plans, write = [], session.written

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *args)

    monkeypatch.setattr(session, "written", seen)
    plans.append(catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    keys = GROWING if name in SEARCHED else GROWING.replace("(?:", r"(?:qid#|")
    assert len(plans) > 1
    assert not re.findall(keys, "\n".join(plans))


def test_alike_queries_are_searched_once(spark):
    typed, firsts = catalogue._alike(spark, "/root/testdata/sf0.01")
    rows = typed.collect()
    texts = {(tuple(r["tokens"]), r["in_progress"]) for r in rows}
    assert len(texts) < len(rows)
    assert firsts.count() == len(texts)
    assert all(r["first"] == min(o["qid"] for o in rows if (o["tokens"], o["in_progress"]) == (r["tokens"], r["in_progress"])) for r in rows)
