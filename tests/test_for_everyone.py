"""What is found once for each text and name is given to every query and entity that has it."""

import random
import re

from registrum.operators import match as M
from registrum.plans import catalogue

SF = "/root/testdata/sf0.001"


def _case(spark):
    rng = random.Random(7)
    typed = [(q, rng.choice("xyzw")) for q in range(40)] + [(None, "x")]
    owned = [(e, rng.choice("abcd")) for e in range(300)] + [(900 + e, "a") for e in range(500)] + [(None, "a"), (5_000, "e")]
    found = [(t, s, rng.randint(0, 3), rng.random()) for t in "xyzv" for s in "abc" if (t, s) != ("y", "c")] + [("x", None, 1, 0.5)]
    frames = (spark.createDataFrame(found, "text string, shape string, n int, coverage double"), spark.createDataFrame(typed, "qid long, text string"), spark.createDataFrame(owned, "lei long, shape string"))
    every = [(q, e, n, c) for t, s, n, c in found for q, u in typed if u == t and q is not None for e, v in owned if v == s and e is not None]
    return *frames, sorted(every)


def test_every_query_and_entity_has_its_row(spark):
    found, typed, owned, every = _case(spark)
    for size, made in ((4_096, 20_000_000), (16, 500), (1, 1_000)):
        df = M.for_everyone(found, M.gathered(typed, "text", "qid", size), M.gathered(owned, "shape", "lei", size), made)
        assert sorted(map(tuple, df.collect())) == every
        assert df.rdd.getNumPartitions() >= len(every) / made


def test_common_keys_are_dealt_to_several_rows(spark):
    lists = M.gathered(_case(spark)[2], "shape", "lei", 64).where("shape = 'a'").collect()
    assert len(lists) >= 8 and max(r.n for r in lists) < 128
    assert all(r.n == len(r.ids) and r.ids == sorted(r.ids) for r in lists)


def test_nothing_found_is_no_rows(spark):
    found, typed, owned, _ = _case(spark)
    assert M.for_everyone(found.where("n > 9"), M.gathered(typed, "text", "qid"), M.gathered(owned, "shape", "lei")).count() == 0


def test_rows_for_each_are_made_last(spark):
    """No join, sort or shuffle comes after the rows of match_features have been dealt out to queries and entities."""
    plan = catalogue.match_features(spark, SF)._jdf.queryExecution().executedPlan().toString()
    nodes = re.findall(r"^[ +:\-*()0-9]*([A-Z]\w+)", plan, re.M)
    assert [x for x in nodes if x not in ("AdaptiveSparkPlan", "Project")][:3] == ["Generate", "Generate", "Exchange"]
