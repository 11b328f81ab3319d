"""Names of builds, skipped rows, lookups by code, reports and evaluation files, causes, and streams, by literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from registrum.functions import render as R
from registrum.operators import build as B
from registrum.operators import entities as E
from registrum.operators import evalsets as S
from registrum.operators import evaluate as V
from registrum.operators import fit as W
from registrum.operators import records as C
from registrum.operators import research as Q
from registrum.sources import files
from registrum.streaming import caches


def test_names_of_an_entity(spark):
    others = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind")) for n, k in (("Old Name", "PREVIOUS_LEGAL_NAME"), ("L M Ericsson", "TRADING_OR_OPERATING_NAME"), ("Ericsson, LM", "ALTERNATIVE_LANGUAGE_LEGAL_NAME"), ("", "TRADING_OR_OPERATING_NAME"))))
    rows = spark.range(1).select(F.lit("L").alias("lei"), F.lit("LM Ericsson").alias("name"), B.variants(others, F.array(F.lit("Erikson | Co"), F.lit("!"))).alias("variants"))
    assert [(v.type, v.name) for v in rows.first().variants] == [(1, "L M Ericsson"), (1, ""), (2, "Ericsson, LM"), (3, "Erikson | Co"), (3, "!"), (4, "Old Name")]
    named = B.indexed_names(rows)
    assert sorted((r.name_no, r.seq) for r in named.collect()) == [(0, ["lm", "ericsson"]), (3, ["ericsson", "lm"]), (4, ["erikson", "co"])]
    assert rows.select(B.listed_names(F.col("variants"), F.col("name")).alias("n")).first().n == ["L M Ericsson", "Ericsson, LM", "Erikson | Co", "!"]
    terms = B.entity_terms(named, rows.select("lei"))
    assert sorted(terms.first().terms) == ["co", "ericsson", "erikson", "lm"]
    counts = B.build_counters(spark.createDataFrame([("x", "SE", "ISSUED", "n")], "lei string, country string, registration string, name string"), E.skip_reason(), rows, terms).first()
    assert tuple(counts) == (1, 1, 1, 0, 0)


def test_initials_give_terms_to_the_prominent(spark):
    rows = spark.createDataFrame([("A", "Royal Bank of Canada"), ("B", "Royal Bank of Canada")], "lei string, name string").withColumn("variants", F.expr("cast(array() as array<struct<type:int,place:int,name:string>>)"))
    got = {r.lei: (sorted(r.terms), r.initials) for r in B.entity_terms(B.indexed_names(rows), rows.where("lei = 'A'").select("lei")).collect()}
    assert got == {"A": (["bank", "canada", "of", "rbc", "royal"], 1), "B": (["bank", "canada", "of", "royal"], 0)}


def test_names_split_by_place(spark):
    pair = lambda n, k: [tuple(x) for x in spark.range(1).select(B.positional_names(F.lit(n), F.lit(k)).alias("p")).first().p]
    assert pair("a | b", "X | Y") == [("a", "X"), ("b", "Y")] and pair("a | b | c", "X | Y") == [("a", "X"), ("b", "Y")] and pair("", "") == [] and pair("a", "X | Y") == [("a", "X")]


def test_skipped_rows_stop_a_build(spark):
    good, bad = ("0" * 20, "SE", "ISSUED", "n"), ("x", "SE", "ISSUED", "n")
    rows = lambda n: spark.createDataFrame([good] * 5000 + [bad] * n, "lei string, country string, registration string, name string")
    assert E.check_skipped(rows(5)).count() == 5000
    with pytest.raises(ValueError, match="6 of 5006"):
        E.check_skipped(rows(6))
    variants = spark.createDataFrame([("A", "x", 2), ("A", "x", 1), ("B", "x", 3)], "lei string, shape string, no int")
    assert sorted(tuple(r) for r in E.first_variants(variants, "lei", "shape", ["no"]).collect()) == [("A", "x", 1), ("B", "x", 3)]
    assert spark.range(1).select(E.listed_names(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.lit("b")).alias("n")).first().n == ["a"]


def test_lookups_by_code(spark):
    asked = spark.createDataFrame([(" US0378331005 ",), ("ABCDUS33",), ("ABCDUS33XXX",), ("none",)], "code string")
    isins = spark.createDataFrame([("US0378331005", "A"), ("US0378331005", "B")], "isin string, lei string")
    bics = spark.createDataFrame([("ABCDUS33XXX", "C")], "bic string, lei string")
    assert sorted(tuple(r) for r in C.find_by_isin(asked, isins).collect()) == [(" US0378331005 ", "A"), (" US0378331005 ", "B")]
    assert sorted(tuple(r) for r in C.find_by_bic(asked, bics).collect()) == [("ABCDUS33", "C"), ("ABCDUS33XXX", "C")]


def test_small_functions(spark):
    d = spark.createDataFrame([("https://a",), ("HTTP://a",), ("javascript:x",), (None,)], "u string")
    assert [r[0] for r in d.select(R.safe_url(F.col("u"))).collect()] == ["https://a", "HTTP://a", None, None]
    asked = spark.createDataFrame([(["roy", "can"], ["royal", "canada"]), (["x"], ["royal"]), ([], [])], "q array<string>, t array<string>")
    assert [r[0] for r in asked.select(S.answerable(F.col("q"), F.col("t"))).collect()] == [True, False, True]
    shown = lambda hits, tokens, short, bad: caches.phase(F.lit(hits), F.array(*map(F.lit, tokens)), F.lit(short), F.lit(bad))
    row = spark.range(1).select(shown(2, ["a"], False, True), shown(0, ["a"], False, True), shown(0, [], False, False), shown(0, ["a"], True, False), shown(0, ["abc"], False, False)).first()
    assert list(row) == ["done", "bad-lei", "idle", "short", "no-match"]
    q = spark.createDataFrame([(["ab"],), (["abcde"],), (["a"],), (["ab", "cd"],)], "t array<string>")
    assert [r[0] for r in q.select(V.is_short(F.col("t"))).collect()] == [True, False, False, False]


def test_strength_is_chosen_by_the_other_fold(spark):
    rows = [(q, q % 2, e, e == 0, float(e == 0), float(e == 0) + (q % 5) * 0.1 * e) for q in range(8) for e in range(3)]
    cand = spark.createDataFrame(rows, "qid int, stratum int, lei int, target boolean, score double, a double").withColumn("fold", F.col("qid") % 2)
    best, means = W.choose_strength(cand, ["a"], [0.1, 10.0], lambda w, part: w["a"])
    assert best == 0.1 and means[0.1] > means[10.0] > 0


def test_causes(spark):
    ranks = spark.createDataFrame([(k, r) for k, r in enumerate([1, None, None, None, None, None, 4])], "qid int, rank int")
    targets = spark.createDataFrame([(k, "T" if k != 2 else "U") for k in range(7)], "qid int, lei string")
    routed = spark.createDataFrame([(k, [] if k == 1 else [0]) for k in range(7)], "qid int, files array<int>")
    pool = spark.createDataFrame([(5, "T"), (6, "T")], "qid int, lei string")
    got = {r.qid: r.cause for r in V.causes(ranks, routed, spark.createDataFrame([("T",)], "lei string"), pool, spark.createDataFrame([(3,)], "qid int"), targets).collect()}
    assert [got[k] for k in range(7)] == ["first", "not routed", "not in index", "not a candidate: no word", "not a candidate", "no name matches", "scored low"]


def test_replays_must_hold_the_same(spark):
    a = spark.createDataFrame([(1, "s", "A", 2), (2, "s", "B", None)], "qid int, stratum string, lei string, rank int")
    got = {r.stratum: (r.n, r.before, r.after, r.gain) for r in V.compare_replays(a, a.withColumn("rank", F.lit(1))).collect()}
    assert got == {"s": (2, 0.25, 1.0, 0.75), "objective": (2, 0.25, 1.0, 0.75)}
    with pytest.raises(Exception, match="different queries"):
        V.compare_replays(a, a.where("qid = 1")).collect()


def test_index_lines_and_manifests(spark, tmp_path):
    ddl = "file int, rank int, lei string, tenths int, country string, status string, name string, other_names array<string>"
    good = (0, 1, "L1", 12, "SE", "I", "Acme", ["B"])
    for k, (at, value) in enumerate(((2, "l 1"), (4, "S"), (5, "II"), (6, ""), (7, ["Acme"]), (7, [""]))):
        row = list(good)
        row[at] = value
        with pytest.raises(Exception, match="bad|empty|twice"):
            files.write_index(spark.createDataFrame([tuple(row)], ddl), str(tmp_path / f"i{k}"))
    manifest = {"format": 1, "build": "20260916-a", "asOf": "2026-09-16", "entities": 3, "bounds": ["a", "b"], "capped": [1]}
    for k, change in enumerate(({"asOf": "2026-09-17"}, {"capped": [2]}, {"capped": [1, 0]}, {"format": 2}, {"build": "x"})):
        (tmp_path / f"m{k}.json").write_text(json.dumps(manifest | change))
        with pytest.raises(Exception, match="bad manifest"):
            files.read_manifest(spark, str(tmp_path / f"m{k}.json")).collect()


def test_encodings(spark):
    import gzip

    lines = spark.createDataFrame([(0, 1, "a\t1\tx"), (0, 2, "b\t2"), (1, 1, "é\t3")], "file int, rank int, line string")
    texts = {"lines": ["a\t1\tx\nb\t2", "é\t3"], "json": ['[["a","1","x"],["b","2"]]', '[["é","3"]]'], "columns": ["a\tb\n1\t2\nx\t", "é\n3"]}
    got = {r.encoding: (r.files, r.raw, r.gzip) for r in files.encodings(lines).collect()}
    assert got == {n: (2, sum(len(t.encode()) for t in ts), sum(len(gzip.compress(t.encode(), 6)) for t in ts)) for n, ts in texts.items()}


def test_research(spark):
    e = spark.createDataFrame([("A", "ACTIVE", "ISSUED", 6, 100), ("B", "INACTIVE", "LAPSED", 120, 0)], "lei string, entity_status string, registration string, name_length int, n_children long")
    assert [r[0] for r in e.select(Q.baseline_score()).collect()] == [15.0 + 13.0 + 72.0, 4.0 - 45.0]
    table = spark.createDataFrame([(0, "a", False), (1, "b", False), (2, "ba", False)], "file int, lo string, capped boolean")
    q = spark.createDataFrame([(1, ["apple", "b"], True), (2, ["bad", "to"], False)], "qid int, tokens array<string>, in_progress boolean")
    route = lambda mode: {r.qid: r.files for r in Q.route_words(q, table, mode).collect()}
    assert route("first") == {1: [0], 2: [2]} and route("longest") == {1: [0], 2: [2]} and route("merged") == {1: [0, 1, 2], 2: [2]}
    with pytest.raises(ValueError, match="no router"):
        Q.route_words(q, table, "x")


def test_weights_and_builds(spark, tmp_path):
    assert files.write_weights(str(tmp_path / "w.json"), {"a": 2.0}, {"b": 1.0, "a": 1.0}) == {"a": 2.0, "b": 1.0}
    assert (tmp_path / "w.json").read_text() == '{"a": 2.0, "b": 1.0}\n'
    for bad in ({"c": 1.0}, {"a": float("nan")}):
        with pytest.raises(ValueError, match="no such weights"):
            files.write_weights(str(tmp_path / "w.json"), bad, {"a": 1.0})
    (tmp_path / "index.json").write_text(json.dumps({"format": 1, "build": "b2"}))
    with pytest.raises(FileNotFoundError, match="b2"):
        files.read_build(spark, str(tmp_path))
    (tmp_path / "b2" / "file=0").mkdir(parents=True)
    (tmp_path / "b2" / "file=0" / "x.txt").write_text("line\n")
    build, lines = files.read_build(spark, str(tmp_path))
    assert build == "b2" and [(r.file, r.value) for r in lines.collect()] == [(0, "line")]
