"""Literal vectors and plain Python twins of records, pages, highlights, fitting, evaluation sets, inputs and caches."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from registrum.functions import render as R
from registrum.functions import text as T
from registrum.operators import assemble as A
from registrum.operators import evalsets as S
from registrum.operators import fit as W
from registrum.operators import highlight as H
from registrum.operators import match as M
from registrum.operators import records as C
from registrum.sources import inputs
from registrum.streaming import caches


def one(spark, values, make):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(make(F.col("v"))).collect()]


def test_links(spark):
    assert one(spark, ["#q=a+b%20c ", "#q=", "#about", "#q=%E0%A4%A", "#q=%FF", "#q=" + "x" * 300, None], R.query_from_hash) == ["a b c", None, None, None, None, "x" * 200, None]
    assert one(spark, ["https://a/b c(d)é😀", "https://a", None], R.markdown_url) == ["https://a/b%20c%28d%29%C3%A9%F0%9F%98%80", "https://a", None]
    assert one(spark, ["https://a.b/x?y=1#z", "https://a.b", "https://a.b//c"], lambda c: R.redirect_location(c, "https://t/")) == ["https://t/x?y=1", "https://t/", "https://t//c"]
    assert [tuple(x) for x in one(spark, ["/lei/X.json", "/lei/X", "/lei/X.md/"], R.split_extension)] == [("/lei/X", ".json"), ("/lei/X", ""), ("/lei/X/", ".md")]
    assert one(spark, ["/lei/hwupkr0mpou8fgxbt394", "/lei/HWUPKR0MPOU8FGXBT394", "/x", "/lei/%"], R.lei_of_path) == [("HWUPKR0MPOU8FGXBT394", False), ("HWUPKR0MPOU8FGXBT394", True), None, None]
    assert one(spark, ['<a href="https://x.org/elf.csv"><a href="https://x.org/ra.csv">', ""], lambda c: R.listed_link(c, "ra")) == ["https://x.org/ra.csv", None]


def test_escapes_formats_and_times(spark):
    assert one(spark, ["a*b_c\nd", "- x", "1. y", "http://x www.a", None], R.escape_markdown) == ["a\\*b\\_c d", "\\- x", "1\\. y", "http\\://x www\\.a", None]
    accepts = {None: "html", "text/markdown": "markdown", "application/json;q=0.9,text/html": "html", "text/*;q=0.5,application/json": "json", "text/html;q=0.2, application/json;q=0.3, text/markdown;q=0.3": "markdown", "json": "html", "text/markdown;q=2": "html"}
    assert one(spark, list(accepts), R.pick_format) == list(accepts.values())
    now = F.lit("2026-01-01 10:00:00").cast("timestamp")
    assert one(spark, ["2026-01-01T00:00:00Z", "x", None, "2025-12-01T00:00:00Z", "2026-01-05T00:00:00Z"], lambda c: R.record_ttl(c, now)) == [54000, 3600, 3600, 300, 86400]


def test_highlight(spark):
    assert H.mark_ranges(["maer", "mol"], "A.P. Møller - Mærsk A/S") == [(5, 8), (14, 17)]
    assert H.mark_ranges(["ap"], "A.P. Møller") == [(0, 3)]
    assert H.mark_ranges(["strasse"], "Straße 5") == [(0, 6)]
    assert H.name_marks(["zzz"], "Acme", ["x", "Zzz Ltd", "Zzz AB"]) == ([], "Zzz Ltd", [(0, 3)])
    pairs = [(q, t) for q in ("bolt", "blt", "otbl", "wdiget", "a") for t in ("bolt", "bolts", "widget", "oblt", "a", "ab", "botl")]
    got = M.levels(spark.createDataFrame(pairs, "q string, t string")).collect()
    assert all(r["level"] == H.level(r["q"], r["t"]) for r in got)
    rows = H.highlight(spark.createDataFrame([(["acm"], "Acme", None), (None, None, None)], "tokens array<string>, name string, others array<string>")).collect()
    assert sorted(len(r["legal"]) for r in rows) == [0, 1]


def _document():
    entity = {"legalName": {"name": "Apple Inc.", "language": "en"}, "otherNames": [{"name": "Apple Computer", "language": "en", "type": "PREVIOUS_LEGAL_NAME"}, {"name": ""}], "status": "ACTIVE", "legalAddress": {"addressLines": ["330 N Brand"], "city": "Glendale", "region": "US-CA", "postalCode": "91203"}, "registeredAt": {"id": "RA000598"}, "registeredAs": "806592", "legalForm": {"id": "H1UM", "other": ""}, "successorEntity": {"lei": "S" * 20}}
    data = {"id": "HWUPKR0MPOU8FGXBT394", "attributes": {"bic": ["APPLUS33XXX"], "entity": entity, "registration": {"status": "ISSUED", "nextRenewalDate": "2027-01-01T00:00:00Z"}}, "relationships": {"direct-parent": {"data": {"type": "reporting-exceptions", "id": "e"}}, "ultimate-parent": {"data": {"type": "lei-records", "id": "P" * 20}}}}
    return {"data": data, "included": [{"type": "reporting-exceptions", "id": "e", "attributes": {"reason": "NO_KNOWN_PERSON"}}]}


def test_record(spark):
    docs = spark.createDataFrame([(1, json.dumps(_document())), (2, "{}"), (3, None), (4, "not json")], "k int, doc string")
    lists = (spark.createDataFrame(rows, "code string, name string") for rows in ([("H1UM", "Corporation")], [("RA000598", "Register [CA]")]))
    named = C.build_documents(C.parse_record(docs, "doc", "https://api").select("k", "record"), spark.createDataFrame([("P" * 20, "Parent Co")], "lei string, name string"), *lists, "https://o")
    named = named.withColumn("rows", C.record_rows(F.col("record")))
    out = named.select("k", C.render_markdown(F.col("record"), F.col("rows"), "https://o").alias("md"), C.json_ld(F.col("record"), "https://o").alias("ld"), C.valid_document(F.to_json(F.struct("url", "record.*"))).alias("ok"), C.leis_to_name(F.col("record")).alias("wanted")).orderBy("k").collect()
    assert [(r["md"], r["ld"], r["ok"]) for r in out[1:]] == [(None, None, False)] * 3
    lines = out[0]["md"].split("\n")
    assert lines[:4] == ["# Apple Inc.", "", "LEI: HWUPKR0MPOU8FGXBT394", ""] and out[0]["ok"]
    assert "- **register:** 806592 (Register \\[CA\\] · RA000598)" in lines and "- **parent:** none: no known person" in lines
    assert f"- **ultimate:** [Parent Co](https://o/lei/{'P' * 20}) ({'P' * 20})" in lines and "- **legal form:** Corporation (H1UM)" in lines
    assert out[0]["wanted"] == ["P" * 20, "S" * 20]
    ld = json.loads(out[0]["ld"])
    assert ld["identifier"][1] == {"@type": "PropertyValue", "propertyID": "RA000598", "value": "806592"} and "alternateName" not in ld


def test_initials(spark):
    q = spark.createDataFrame([(1, ["ibm"]), (2, ["ib"])], "qid int, tokens array<string>")
    names = spark.createDataFrame([("L1", 0, ["international", "business", "machines"], [], ["ibm"]), ("L2", 0, ["ibmo"], [], []), ("L3", 0, ["x"], [], ["ibm"])], "lei string, name_no int, seq array<string>, extras array<string>, initials array<string>")
    ents = spark.createDataFrame([("L1", 2.0), ("L2", 1.0), ("L3", 0.5)], "lei string, prominence double")
    got = [(r["qid"], r["lei"]) for r in M.top_k(q, names, ents, 5).orderBy("qid", "rank").collect()]
    assert got == [(1, "L1"), (1, "L2"), (2, "L2")]


def test_fit_gradient(spark):
    rng = np.random.default_rng(1)
    rows = [(q, q % 2, e, e == 0, float(e == 0), *map(float, rng.normal(size=2) + (e == 0))) for q in range(12) for e in range(4)]
    cand = spark.createDataFrame(rows, "qid int, stratum int, lei int, target boolean, score double, a double, b double")
    design = W.prepare(cand, ["a", "b"])
    x = np.array([r[5:] for r in rows]).reshape(12, 4, 2)

    def loss(w):
        s = x @ w
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[:, 0])) + 0.05 * w @ w

    w = np.array([0.3, -0.2])
    got = W.loss_terms(design, ["a", "b"], w, 0.1)
    step = 1e-5
    slope = [(loss(w + step * d) - loss(w - step * d)) / (2 * step) for d in np.eye(2)]
    assert got[0] == pytest.approx(loss(w)) and np.allclose(got[1], slope, atol=1e-7)
    best, least = W.fit(design, ["a", "b"], 0.1)
    v = np.array(list(best.values()))
    assert least == pytest.approx(loss(v)) and all(loss(v + d) > least for d in (*np.eye(2) * 0.05, *np.eye(2) * -0.05))
    assert 0 < W.reciprocal_rank(best, cand) <= 1
    assert W.search_coordinates({"a": 0.0}, {"a": 1.0}, lambda c: -abs(c["a"] - 3)) == ({"a": 3.0}, 0)


def test_evaluation_sets(spark):
    assert one(spark, ["US-TX", "Q42", "NYSE: ABC", "Fla.", "1234", "Acme", "AB 12345", "Sony"], S.is_code) == [True, True, True, True, True, False, True, False]
    assert one(spark, ["AT&T", "a b", "A.P. Co"], S.frozen_tokens) == [["at", "t"], ["ab"], ["ap", "co"]]
    assert [tuple(x) for x in one(spark, ["the acme holding ag", "ag", "acme co ltd", ""], lambda c: S.core_range(T.name_seq(c), ["holding ag", "ltd", "co", "ag"]))] == [(1, 2), (0, 1), (0, 1), (0, 0)]
    words = ["international", "blue bolt", "cat", "ab cd", None]
    for early in (True, False):
        for w, t in zip(words, one(spark, words, lambda c: S.typo(c, c, "s", early)), strict=True):
            if w is None or len(w.replace(" ", "")) < 5 and not (w == "ab cd"):
                assert t is None
            elif t is not None:
                assert t["text"] != w and abs(len(t["text"]) - len(w)) <= 1 and (t["at"] < 4) >= early
    items = spark.createDataFrame([("Q1", "A", "Acme", ["ACM", "Acme", "Q9"], "5"), ("Q2", "A", "Other", [], "4"), ("Q3", "B", "Bolt", [], "9"), ("Q4", "C", "Q4", [], "99")], "qid string, lei string, label string, aliases array<string>, links string")
    got = {(r["qid"], r["query"]) for r in S.head(items, 10, "s", 3).collect()}
    assert got == {("Q1", "Acme"), ("Q1", "ACM"), ("Q3", "Bolt")}
    q = spark.createDataFrame([("X", "A", None), ("Y", "B", ["T"])], "query string, lei string, alternatives array<string>")
    ents = spark.createDataFrame([("A", "Acme", "ACTIVE")], "lei string, name string, entity_status string")
    assert [r["name"] for r in S.acronyms(q, spark.createDataFrame([("T",)], "lei string"), ents, "s").collect()] == ["Acme"]
    with pytest.raises(Exception, match="not in the copy"):
        S.acronyms(q, spark.createDataFrame([("U",)], "lei string"), ents, "s").collect()


def test_caches(spark):
    rows = [(s, i, k, float(i)) for s in (1, 2) for i, k in enumerate("abacbcaad")]
    e = spark.createDataFrame(rows, "s int, i int, k string, t double").withColumn("at", F.col("t").cast("timestamp"))
    got = [r["hit"] for r in caches.recently_used(e, "s", ["i"], "k", 2).where("s = 1").orderBy("i").collect()]
    assert got == [False, False, True, False, False, True, False, True, False]
    got = [r["hit"] for r in caches.unexpired(e, "s", ["i"], "k", "at", 3).where("s = 2").orderBy("i").collect()]
    assert got == [False, False, True, False, False, True, False, True, False]
    assert caches.recently_used(e.where("s = 9"), "s", ["i"], "k", 2).count() == 0


def test_inputs_and_assembly(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("20260916-0800-copy.csv", "x,y\n1,2\n")
    found = inputs.local_inputs(str(tmp_path), ["a.zip"], ["b.zip"], dated="a.zip")
    assert found["as_of"] == "2026-09-16" and found["b.zip"] is None
    assert open(inputs.extract(found["a.zip"], str(tmp_path))).read() == "x,y\n1,2\n"
    with pytest.raises(FileNotFoundError):
        inputs.local_inputs(str(tmp_path), ["c.zip"])
    copy = inputs.download((tmp_path / "a.zip").as_uri(), str(tmp_path / "got.zip"))
    assert inputs.first_member(copy) == "20260916-0800-copy.csv"
    p = spark.createDataFrame([("2026-09-16 16:00:00",), ("2026-09-16 08:00:00",), ("2026-09-17 00:00:00",)], "publish_date string")
    assert [inputs.resolve_publish(p, d).first()[0] for d in ("2026-09-16", "2026-09-17", "latest")] == ["2026-09-16 08:00:00", "2026-09-17 00:00:00", "2026-09-17 00:00:00"]
    codes = spark.createDataFrame([("B", "b"), ("A", "é")], "code string, name string")
    assert inputs.codes_document(codes) == '{"elf":{"A":"é","B":"b"}}'

    def build(name, passed=True):
        d = tmp_path / f"build-{name}"
        (d / name).mkdir(parents=True)
        (d / "index.json").write_text(json.dumps({"build": name, "bounds": ["", "m"]}))
        (d / "measured.json").write_text(json.dumps({"passed": passed, "report": {"build": name}}))
        for n in ("0.txt", "1.txt", "codes.json"):
            (d / name / n).write_text(f"{name} {n}")
        return str(d)

    out, first, second = str(tmp_path / "out"), build("b1"), build("b2")
    assert A.assemble(first, out) == {"build": "b1", "previous": None, "files": 5} and A.verify(out, first) == []
    assert A.assemble(second, out, live_dir=out)["previous"] == "b1" and A.verify(out, second) == [] and A.verify(out, first) == ["index.json differs"]
    with pytest.raises(ValueError, match="did not pass"):
        A.assemble(build("b3", passed=False), out)
    (tmp_path / "out" / "b2" / "1.txt").write_text("changed")
    assert A.verify(out, second) == ["b2/1.txt differs"]
