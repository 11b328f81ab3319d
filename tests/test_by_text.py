"""Distinct texts and names worked out once give what every query and entity gives."""

import random

from registrum.operators import evaluate as V
from registrum.operators import fit as W
from registrum.operators import match as M
from registrum.plans import catalogue, pages, studies  # noqa: F401
from registrum.plans.tables import parts, table

SF = "/root/testdata/sf0.001"


def test_best_items_round_halves_to_even(spark, tmp_path):
    """As the SQL's cast does: 2.5 counts as 2 links, and of equals the least number stands."""
    rows = [(1, 7, 2.0), (2, 7, 2.5), (3, 8, 3.0), (4, 8, 3.5)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert {r.lei: r.qid for r in pages.best_items(spark, str(tmp_path)).collect()} == {"7": "Q1", "8": "Q4"}


def test_grid_holds_each_text_and_name_once(spark):
    texts, found = catalogue._by_text(spark, SF)
    alike = parts(spark, SF).select("seq", "prominence").distinct().count()
    assert found.count() <= texts.select("text").distinct().count() * alike < texts.count() * table(spark, SF, "part").count()


def test_rank_among_owners(spark):
    rng = random.Random(5)
    names = [(e, rng.choice("abc"), rng.randint(0, 2) / 2) for e in range(60)]
    owners = spark.createDataFrame([(s, e, p) for e, s, p in names], "shape string, lei long, prominence double")
    match = {(t, s): rng.randint(0, 2) / 2 for t in ("x", "y") for s in "abc" if (t, s) != ("y", "c")}
    scored = spark.createDataFrame([(t, s, p, m + p) for (t, s), m in match.items() for p in sorted({p for _, n, p in names if n == s})], "text string, shape string, prominence double, score double")
    texts = {1: "x", 2: "y", 3: "x", 4: "z"}
    targets = spark.createDataFrame([(q, texts[q], e) for q in texts for e in rng.sample(range(60), 20)], "qid long, text string, lei long")
    every = spark.createDataFrame([(q, e, match[t, s] + p) for q, t in texts.items() for e, s, p in names if (t, s) in match], "qid long, lei long, score double")
    got = sorted(map(tuple, V.rank_of_owner(scored, owners, targets).collect()), key=str)
    assert got == sorted(map(tuple, V.rank_of_target(every, targets.select("qid", "lei")).collect()), key=str)


def _twice(rows):
    """Queries 0 and 1 with the same candidates, and alike entities: as they are, and once with their numbers."""
    plain = [(q, q0 % 2, e * 10 + c, t, s, a) for q0, e, t, s, a, n in rows for q in (q0, q0 + 100) for c in range(n)]
    return plain, [(q0, q0 % 2, e * 10, t, s, a, n, 2) for q0, e, t, s, a, n in rows]


def test_weights_of_rows_that_stand_for_many(spark):
    rng = random.Random(3)
    rows = [(q, e, e < 2, rng.random(), rng.random() + (e < 2), rng.randint(1, 4)) for q in range(6) for e in range(4)]
    plain, short = _twice(rows)
    ddl = "qid int, stratum int, lei int, target boolean, score double, a double"
    one = W.fit(W.prepare(spark.createDataFrame(plain, ddl), ["a"]), ["a"], 0.1)
    two = W.fit(W.prepare(spark.createDataFrame(short, ddl + ", n int, times int"), ["a"]), ["a"], 0.1)
    assert abs(one[0]["a"] - two[0]["a"]) < 1e-7 and abs(one[1] - two[1]) < 1e-9


def test_ablations_of_texts_that_stand_for_many(spark):
    rows = [(q, e, e == q % 3, 0.0, (e * 7 + q) % 5 / 1.0, 1) for q in range(5) for e in range(4)]
    plain, short = _twice(rows)
    ddl = "qid int, stratum int, lei int, target boolean, score double, a double"
    one = W.ablations(spark.createDataFrame(plain, ddl), {"a": 1.0}, {"none": ["a"]})
    two = W.ablations(spark.createDataFrame([(*r[:6], r[7] if r[0] else 5) for r in short], ddl + ", times int"), {"a": 1.0}, {"none": ["a"]})
    more = W.ablations(spark.createDataFrame([*plain, *((200 + k, *r[1:]) for k in range(3) for r in plain if r[0] == 0)], ddl), {"a": 1.0}, {"none": ["a"]})
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, more.collect())) and one.count() == two.count()
