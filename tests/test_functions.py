"""Literal vectors of the search semantics, and twins in plain Python."""

import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from registrum.functions import constants as C
from registrum.functions import identifiers as I
from registrum.functions import numeric as N
from registrum.functions import text as T
from registrum.operators import index as X
from registrum.operators import match as M


def one(spark, values, make):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(make(F.col("v"))).collect()]


def test_fold(spark):
    """Every letter that has a fold, alone and among others, equals the plain fold."""
    rng = random.Random(2)
    pool = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co")]
    texts = ["Mærsk Ørsted Straße Łódź Þór", "E.ON SE", "Ünï", "Œuvre", "ﬁnance ﬂow", "plain", "Ａｃｍｅ", "Ⅻ Ltd", "x²", "İstanbul ΣΑΣ", "한국 전력", "שָׁלוֹם", None, ""]
    texts += [" ".join(pool[k : k + 60]) for k in range(0, len(pool), 60)]
    texts += ["".join(rng.choice([rng.choice(pool), rng.choice("abC 1.-&")]) for _ in range(20)) for _ in range(200)]
    assert one(spark, texts, T.fold) == [None if t is None else T.fold_text(t) for t in texts]
    assert one(spark, texts, T.query_tokens) == [None if t is None else _tokens(t) for t in texts]


def _tokens(text):
    out = []
    for chunk in re.split("[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", T.fold_text(text)):
        runs = re.findall("[a-z0-9]+", chunk)
        out += ["".join(runs)] if len(runs) > 1 and max(map(len, runs)) <= 2 else runs
    joined = []
    for single, group in itertools.groupby(out, key=lambda x: len(x) == 1):
        joined += ["".join(group)] if single else group
    return joined


def test_tokens(spark):
    assert one(spark, ["A.P. Møller - Mærsk A/S", "AT&T", "L M Ericsson", "a b c d", ""], T.name_seq) == [["ap", "moller", "maersk", "as"], ["att"], ["lm", "ericsson"], ["abcd"], []]
    assert one(spark, ["AT&T", "Coca-Cola"], T.name_extras) == [["at"], ["cocacola"]]
    assert one(spark, ["erics", "", "ericsson ", "x ", "x　"], T.last_is_prefix) == [True, True, False, False, False]


def test_forms_and_initials(spark):
    names = {"Skandinaviska Enskilda Banken AB (publ)": (3, ["seb"]), "BP P.L.C.": (1, []), "SAS AB": (1, []), "AB": (1, []), "International Business Machines Corporation": (3, ["ibm", "ibmc"]), "Royal Bank of Canada": (4, ["rbc"]), "Acme 2 Holdings": (3, [])}
    assert one(spark, names, lambda v: T.form_start(T.name_seq(v))) == [n for n, _ in names.values()]
    assert one(spark, names, lambda v: T.name_initials(T.name_seq(v), T.form_start(T.name_seq(v)))) == [x for _, x in names.values()]


def test_identifiers(spark):
    assert one(spark, ["529900GRZ2BQY5ZM9N49", "HWUPKR0MPOU8FGXBT394", "HWUPKR0MPOU8FGXBT395", "", None], I.valid_lei) == [True, True, False, False, False]
    assert one(spark, ["US92204Q1031", "US0378331005", "PLING0100027", "ES0A06416689", "US0378331006"], I.valid_isin) == [True] * 4 + [False]
    assert one(spark, ["556016-0680", "HRB 86891", "12345", "Fund 2021", "AB1234", "1999 2021", "US0378331006"], I.register_number) == ["556016-0680", "HRB 86891", "12345", None, None, None, None]


def test_rounding(spark):
    values = spark.createDataFrame([(0.25, 3), (-0.25, -2), (-0.26, -3), (-0.04, 0), (-12.35, -123)], "p double, want long")
    assert all(r[0] == r[1] for r in values.select(N.stored_tenths(F.col("p")), "want").collect())


@pytest.mark.parametrize(
    ("want", "change"),
    [
        (0.0, {}),
        (4.729755401611328, {"n_direct": 12, "n_ultimate": 30, "n_branch": 2, "isin": 500, "bic": True, "registered_year": 2012 + 10 / 12, "name_length": 30}),
        (-1.4208576679229736, {"registration": "LAPSED", "category": "FUND", "has_parent": True, "isin": 3, "registered_year": 2020 + 5 / 12, "name_length": 20}),
        (-0.7784020900726318, {"category": "BRANCH", "n_ultimate": 4, "n_branch": 7, "isin": 49, "bic": True, "registered_year": 2026 + 8 / 12, "name_length": 40}),
    ],
)
def test_prominence(spark, want, change):
    row = {"entity_status": "ACTIVE", "registration": "ISSUED", "category": "GENERAL", "n_direct": 0, "n_ultimate": 0, "n_branch": 0, "isin": 0, "bic": False, "has_parent": False, "registered_year": float("nan"), "name_length": 1} | change
    ddl = "entity_status string, registration string, category string, n_direct long, n_ultimate long, n_branch long, isin long, bic boolean, has_parent boolean, registered_year double, name_length int"
    assert spark.createDataFrame([tuple(row.values())], ddl).select(N.prominence(2026.74)).first()[0] == want


def _within_one(q, t):
    def distance(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    return any(distance(q, t[:k]) <= 1 for k in range(len(t) + 1))


def test_levels_equal_plain_distance(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(60)]
    want = {}
    for q in words[:20]:
        for t in words:
            level = 3 if q == t else 2 if t.startswith(q) else 1 if len(q) >= 4 and _within_one(q, t) else 0
            if level:
                want[q, t] = level
    frame = lambda ws, c: spark.createDataFrame([(w,) for w in ws], f"{c} string")
    found = M.vocabulary_levels(frame(words[:20], "q"), frame(words, "t")).collect()
    assert {(r.q, r.t): r.level for r in found} == want


def test_shards(spark):
    counts = spark.createDataFrame([("ab", 1), ("abc", 1), ("abd", 2), ("abe", 3), ("ac", 1), ("bz", 4)], "term string, cnt long")
    shards = lambda n: X.plan_shards(counts, n)
    assert shards(100).select("shard").distinct().count() == 3
    assert shards(5).select("shard", "alone").distinct().count() == 6
    files = X.pack_files(shards(5), 4).orderBy("lo").collect()
    assert [r.file for r in files] == [0, 0, 0, 1, 1, 2]


def _file_of(bounds, word):
    return max((k for k, lo in enumerate(bounds) if lo <= word), default=0)


def _route(tokens, bounds, capped, open_last, paused, chars=3, span=1, most=2):
    """The files of a query by the definition, word by word."""
    stop, told = set(C.QUERY_STOP), []
    for pos, w in enumerate(tokens):
        if w in stop or len(w) < chars:
            continue
        open_ = open_last and pos == len(tokens) - 1
        narrow = None
        for n in range(chars, len(w) + 1):
            lo, hi = _file_of(bounds, w[:n]), _file_of(bounds, w[:n] + "\uffff")
            if hi - lo + 1 <= span:
                narrow = list(range(lo, hi + 1))
                break
        files = narrow if narrow is not None else [_file_of(bounds, w)] if paused or not open_ else None
        if files is not None:
            told.append((not any(f in capped for f in files) and (narrow is not None or not open_), len(w), -pos, files))
    out = []
    for *_, files in sorted(told, key=lambda x: x[:3], reverse=True)[:most]:
        out += [f for f in files if f not in out]
    if not out and paused and len(tokens) == 1 and len(tokens[0]) >= 2:
        out = [_file_of(bounds, tokens[0])]
    return out


def test_routes_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abcd", k=n))
    bounds = sorted({word(rng.randint(2, 5)) for _ in range(14)})
    capped = {k for k in range(len(bounds)) if rng.random() < 0.4}
    table = spark.createDataFrame([(k, lo, k in capped) for k, lo in enumerate(bounds)], "file int, lo string, capped boolean")
    asked = [(k, [rng.choice(["the", "of", word(rng.randint(1, 6)), word(rng.randint(3, 6))]) for _ in range(rng.randint(1, 4))], rng.random() < 0.6) for k in range(120)]
    queries = spark.createDataFrame(asked, "qid int, tokens array<string>, in_progress boolean")
    for paused, limits in ((True, {}), (False, {}), (True, {"min_chars": 2, "max_span": 3, "max_anchors": 3})):
        got = {r.qid: r.files for r in X.route(queries, table, paused=paused, **limits).collect()}
        plain = {"chars": limits.get("min_chars", 3), "span": limits.get("max_span", 1), "most": limits.get("max_anchors", 2)}
        assert got == {k: _route(t, bounds, capped, o, paused, **plain) for k, t, o in asked}
    words = spark.createDataFrame([(w,) for w in ["", "a", "zz", *bounds, *(word(4) for _ in range(30))]], "w string")
    assert all(r.f == _file_of(bounds, r.w) for r in X.file_of(words, table, F.col("w"), "f").collect())
    assert {r.f for r in X.file_of(words, table.limit(0), F.col("w"), "f").collect()} == {0}


def test_the_best_names_are_those_of_a_full_scan(spark):
    """Distinct names scored once, with the most prominent entities of each, give what scoring every entity gives."""
    rng = random.Random(7)
    names = [(f"L{k:03}", n, [rng.choice("alpha beta gamma ag".split()) for _ in range(rng.randint(1, 3))]) for k in range(150) for n in range(rng.randint(1, 2))]
    listed = spark.createDataFrame([(e, n, s, []) for e, n, s in names], "lei string, name_no int, seq array<string>, extras array<string>")
    entities = spark.createDataFrame([(e, rng.randint(0, 6) / 2) for e in sorted({e for e, *_ in names})], "lei string, prominence double")
    queries = spark.createDataFrame([(k, [rng.choice(["alpha", "bet", "gamma", "gama"]) for _ in range(rng.randint(1, 2))]) for k in range(12)], "qid int, tokens array<string>")
    got = [tuple(r) for r in M.top_k(queries, listed, entities, 7).orderBy("qid", "rank").collect()]
    every = M.features(queries, listed).withColumn("match", M.match_score()).where("match is not null").groupBy("qid", "lei").agg(F.max("match").alias("m")).join(entities, "lei")
    scored = sorted((r.qid, -(r.m + r.prominence), r.lei) for r in every.collect())
    want = [(q, e, round(-s, 6), k + 1) for q, group in itertools.groupby(scored, key=lambda x: x[0]) for k, (_, s, e) in enumerate(list(group)[:7])]
    assert got == want
    alt = M.features(queries, listed).withColumn("a", M.match_score()).withColumn("b", M.match_score(M.MATCH | {"alt": -1.0})).where("a is not null")
    assert all((r.b == r.a) == (r.name_no == 0) for r in alt.collect())


def test_dates_and_names(spark):
    assert one(spark, ["2012-11-05T00:00:00Z", "2012-11-05", "x", ""], N.registration_year)[:2] == [2012 + 10 / 12] * 2
    assert all(x != x for x in one(spark, ["x", ""], N.registration_year))
    assert one(spark, ["2026-09-16"], lambda c: N.year_fraction(c.cast("date"))) == [2026 + (8 + 15 / 30) / 12]
    assert one(spark, ["\t a\tb\r\n\u3000", None, "\u200b"], T.clean_name) == ["a b", None, "\u200b"]


def test_sizes_are_the_compressors(spark):
    import gzip

    lines = spark.createDataFrame([(0, 2, "b"), (0, 1, "a" * 500), (1, 1, "é")], "file int, rank int, line string")
    got = {r.file: (r.n, r.bytes, r.gzip) for r in X.index_sizes(lines).collect()}
    texts = {0: "a" * 500 + "\nb\n", 1: "é\n"}
    assert got == {k: (t.count("\n"), len(t.encode()), len(gzip.compress(t.encode(), 9))) for k, t in texts.items()}
