"""Queries of builds, replays, sessions and the ranking's study over the driver's tables, and the SQL that each must equal."""

from pyspark.sql import functions as F

from registrum.functions import numeric as N
from registrum.functions import text as T
from registrum.operators import build as B
from registrum.operators import entities as E
from registrum.operators import evaluate as V
from registrum.operators import index as X
from registrum.operators import match as M
from registrum.operators import research as R
from registrum.operators.joins import shuffled
from registrum.plans import tables
from registrum.plans.catalogue import _ENT, _FILES, _POOL_SQL, _RANKED, _TARGETS, _TYPED_SQL, _alike, _bounds, _capped, _of_first, _packed, _ranks, _route_sql, _routing, _targets, _typed
from registrum.plans.registry import query
from registrum.plans.tables import table
from registrum.session import staged, written
from registrum.sources import files as S

# ---- names of entities

_NAMED = """named AS (SELECT c_custkey AS lei, c_name AS name, [{t: 1, p: 0, n: lower(c_name)}, {t: 4, p: 1, n: upper(c_name) || ' old'}, {t: 2, p: 2, n: c_mktsegment}, {t: 1, p: 3, n: CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment || ' | ' || c_nationkey ELSE '' END}, {t: 3, p: 4, n: c_mktsegment || ' Group'}, {t: 3, p: 5, n: c_name}] AS v FROM customer)"""
_EACH = _NAMED + """, each AS (SELECT lei, name, unnest(v) AS u FROM named), ordered AS (SELECT lei, name, u.t AS t, u.p AS p, u.n AS n, row_number() OVER (PARTITION BY lei ORDER BY u.t, u.p) AS no FROM each)"""
_SEQ = "array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' ')"
_INDEXED = _EACH + f""", every_name AS (SELECT lei, 0 AS no, {_SEQ.format('c_name')} AS seq FROM (SELECT c_custkey AS lei, c_name FROM customer) UNION ALL SELECT lei, no, {_SEQ.format('n')} FROM ordered WHERE t < 4),
indexed AS (SELECT lei, no, seq FROM (SELECT *, row_number() OVER (PARTITION BY lei, seq ORDER BY no) AS nth FROM every_name) WHERE no = 0 OR (nth = 1 AND seq <> ''))"""


def _named(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    other = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("kind"))
    joint = F.when(F.col("c_custkey") % 5 == 0, F.concat("c_mktsegment", F.lit(" | "), F.col("c_nationkey").cast("string"))).otherwise("")
    others = F.array(
        other(F.lower("c_name"), "TRADING_OR_OPERATING_NAME"),
        other(F.concat(F.upper("c_name"), F.lit(" old")), "PREVIOUS_LEGAL_NAME"),
        other(F.col("c_mktsegment"), "ALTERNATIVE_LANGUAGE_LEGAL_NAME"),
        other(joint, "TRADING_OR_OPERATING_NAME"),
    )
    transliterated = F.array(F.concat("c_mktsegment", F.lit(" Group")), F.col("c_name"))
    return c.select(F.col("c_custkey").alias("lei"), F.col("c_name").alias("name"), B.variants(others, transliterated).alias("variants"))


@query("WITH " + _EACH + " SELECT lei, string_agg(t || ':' || n, ';' ORDER BY no) AS variants FROM ordered GROUP BY 1")
def name_variants(spark, sf_dir):
    return _named(spark, sf_dir).select("lei", F.array_join(F.transform("variants", lambda v: F.concat(v["type"].cast("string"), F.lit(":"), v["name"])), ";").alias("variants"))


@query("WITH " + _INDEXED + " SELECT lei, seq FROM indexed")
def indexed_names(spark, sf_dir):
    return B.indexed_names(_named(spark, sf_dir)).select("lei", F.array_join("seq", " ").alias("seq"))


@query("WITH " + _EACH + " SELECT lei, coalesce(string_agg(n, ';' ORDER BY least_p) FILTER (n <> name), '') AS names FROM (SELECT lei, name, n, min(p) AS least_p FROM ordered WHERE t < 4 AND n <> '' GROUP BY 1, 2, 3) GROUP BY 1")
def listed_names(spark, sf_dir):
    return _named(spark, sf_dir).select("lei", F.array_join(B.listed_names(F.col("variants"), F.col("name")), ";").alias("names"))


@query("WITH " + _INDEXED + ", terms AS (SELECT DISTINCT lei, unnest(string_split(seq, ' ')) AS term FROM indexed) SELECT lei, string_agg(term, ' ' ORDER BY term) AS terms FROM terms WHERE length(term) >= 2 GROUP BY 1")
def entity_terms(spark, sf_dir):
    n = _named(spark, sf_dir)
    # the extra spellings of joined names are left to the unit tests
    indexed = B.indexed_names(n).withColumn("extras", F.array().cast("array<string>"))
    return B.entity_terms(indexed, n.select("lei").limit(0)).select("lei", F.array_join(F.sort_array("terms"), " ").alias("terms"))


@query("WITH " + _INDEXED + ", joint AS (SELECT count(*) AS n FROM (SELECT n FROM ordered WHERE contains(n, ' | '))), bare AS (SELECT count(*) AS n FROM customer) SELECT (SELECT n FROM bare) AS rows, (SELECT count(*) FROM customer WHERE c_custkey % 9 = 0) AS skipped, (SELECT n FROM joint) AS joint_names, CAST(0 AS BIGINT) AS no_terms, CAST(0 AS BIGINT) AS initials")
def build_counters(spark, sf_dir):
    n = _named(spark, sf_dir)
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 9 == 0, "short").otherwise(F.lpad(F.col("c_custkey").cast("string"), 20, "0")).alias("lei"), F.lit("SE").alias("country"), F.lit("ISSUED").alias("registration"), F.col("c_name").alias("name"))
    return B.build_counters(rows, E.skip_reason(), n, B.entity_terms(B.indexed_names(n), n.select("lei").limit(0)))


@query("WITH c AS (SELECT c_custkey AS lei, [lower(c_name), c_mktsegment || ' | x', c_name] AS names FROM customer), s AS (SELECT lei, string_split(array_to_string(names, ' | '), ' | ') AS n, ['A', 'B', 'C'] AS k FROM c) SELECT lei, array_to_string(list_transform(range(1, least(len(n), len(k)) + 1), lambda i: n[i] || ':' || k[i]), ';') AS pairs FROM s")
def positional_names(spark, sf_dir):
    names = F.array_join(F.array(F.lower("c_name"), F.concat("c_mktsegment", F.lit(" | x")), "c_name"), " | ")
    pairs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lei"), B.positional_names(names, F.lit("A | B | C")).alias("p"))
    return pairs.select("lei", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["name"], x["kind"])), ";").alias("pairs"))


# ---- files of a build

_WHOLE = _FILES + """, shown AS (SELECT file, rank, lei, CAST(floor(round(p_retailprice / 1000, 1) * 10 + 0.5) AS BIGINT) AS tenths, capped FROM capd JOIN part ON p_partkey = lei),
bad AS (SELECT file, CASE WHEN file % 5 = 1 AND rank IN (1, 2) THEN 3 - rank ELSE rank END AS rank, lei, tenths + CASE WHEN file % 5 = 1 AND rank = 1 THEN 1 ELSE 0 END AS tenths FROM shown WHERE file % 7 <> 3),
man AS (SELECT file, coalesce(capped, false) OR file % 11 = 0 AS capped FROM tb WHERE file % 13 <> 5)"""


@query("WITH RECURSIVE " + _WHOLE + """, o AS (SELECT *, lag(tenths) OVER (PARTITION BY file ORDER BY rank) AS prev FROM bad),
h AS (SELECT file, count(*) AS n, count(*) FILTER (prev < tenths) AS rises FROM o GROUP BY 1), m AS (SELECT file, man.capped, man.file IS NOT NULL AS told, n, rises FROM man FULL JOIN h USING (file)),
told AS (SELECT m.file, man.capped, n, rises, man.file IS NULL AS extra FROM (SELECT file, n, rises FROM m) m LEFT JOIN man USING (file))
SELECT file, problem FROM (SELECT file, unnest([CASE WHEN n IS NULL THEN 'missing' END, CASE WHEN extra THEN 'not in the manifest' END, CASE WHEN n > 500 THEN 'over the cap' END, CASE WHEN capped AND n <> 500 THEN 'capped but not full' END, CASE WHEN rises > 0 THEN 'out of order' END]) AS problem FROM told) WHERE problem IS NOT NULL
UNION ALL SELECT NULL, 'another count of entities' WHERE (SELECT count(DISTINCT lei) FROM bad) <> 7""")
def index_problems(spark, sf_dir):
    bounds, capped = _bounds(spark, sf_dir)
    shown = shuffled(capped).join(tables.prominences(spark, sf_dir).select("lei", N.stored_tenths(F.col("prominence")).alias("tenths")), "lei")
    swapped = (F.col("file") % 5 == 1) & F.col("rank").isin(1, 2)
    bad = shown.where("file % 7 <> 3").select("file", F.when(swapped, 3 - F.col("rank")).otherwise(F.col("rank")).alias("rank"), "lei", (F.col("tenths") + F.when((F.col("file") % 5 == 1) & (F.col("rank") == 1), 1).otherwise(0)).alias("tenths"))
    manifest = bounds.where("file % 13 <> 5").select("file", (F.col("capped") | (F.col("file") % 11 == 0)).alias("capped"))
    return B.check_index(bad, manifest, 7, cap=500)


@query("WITH RECURSIVE " + _FILES + """, a AS (SELECT file, rank, lei, round(p_retailprice / 1000, 1) AS p, p_name AS d FROM capd JOIN part ON p_partkey = lei),
b AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY p DESC, lei DESC) AS rank, lei, CASE WHEN lei % 90 = 0 THEN p + 0.25 ELSE p END AS p, CASE WHEN lei % 40 = 0 THEN d || '!' ELSE d END AS d FROM a WHERE file % 7 <> 0 OR lei % 50 <> 0),
pl AS (SELECT file, a.lei IS DISTINCT FROM b.lei AS swap, coalesce(abs(a.p - b.p) <= 1e-6, false) AS near FROM a FULL JOIN b USING (file, rank)),
mv AS (SELECT file, count(*) FILTER (swap) AS moved, bool_and(NOT swap OR near) AS near FROM pl GROUP BY 1),
hd AS (SELECT file, bool_and(a.lei IS NOT NULL AND b.lei IS NOT NULL) AS same, count(*) FILTER (a.d <> b.d) AS other_data, count(*) FILTER (floor(a.p * 10 + 0.5) <> floor(b.p * 10 + 0.5)) AS other_tenths FROM a FULL JOIN b USING (file, lei) GROUP BY 1)
SELECT file, moved, moved > 0 AND same AND near AS ties, other_data, other_tenths FROM mv JOIN hd USING (file) WHERE moved > 0 OR other_data > 0 OR other_tenths > 0""")
def build_differences(spark, sf_dir):
    capped, _ = _capped(spark, sf_dir)
    names = tables.parts(spark, sf_dir).select("lei", "prominence", F.col("name").alias("data"))
    got = capped.select("file", "rank", "lei").join(names, "lei")
    kept = got.where("file % 7 <> 0 OR lei % 50 <> 0")
    order = F.row_number().over(X.Window.partitionBy("file").orderBy(F.col("prominence").desc(), F.col("lei").desc()))
    want = kept.withColumn("rank", order).withColumn("prominence", F.when(F.col("lei") % 90 == 0, F.col("prominence") + 0.25).otherwise(F.col("prominence")))
    return B.compare_files(got, want.withColumn("data", F.when(F.col("lei") % 40 == 0, F.concat("data", F.lit("!"))).otherwise(F.col("data"))))


@query("SELECT '20260916-' || left(sha256(string_agg(file || ':' || h, chr(10) ORDER BY file)), 8) AS build FROM (SELECT p_size AS file, sha256(string_agg(p_partkey || ':' || p_name, chr(10) ORDER BY p_partkey)) AS h FROM part GROUP BY 1)")
def build_id(spark, sf_dir):
    from registrum.operators.publish import content_hash

    p = table(spark, sf_dir, "part").withColumnRenamed("p_size", "file")
    return B.build_id(content_hash(p, "file", ["p_partkey"], F.concat(F.col("p_partkey").cast("string"), F.lit(":"), F.col("p_name"))), "2026-09-16")


@query("SELECT CAST(p_partkey AS VARCHAR) AS lei, round(p_retailprice / 1000, 1) AS prominence, p_size / 10 AS age FROM part")
def prominence_dump(spark, sf_dir):
    """Written as tab-separated lines and read back."""
    from registrum.session import shared_path

    path = shared_path(spark, "prominence")
    S.write_prominence(tables.parts(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lei"), (F.col("p_size") / 10).alias("age")), "lei"), path)
    return spark.read.csv(path, sep="\t", schema="lei string, prominence double, age double")


@query("WITH RECURSIVE " + _FILES + " SELECT 'b1' AS build, '2026-09-16' AS asOf, count(DISTINCT lei) AS entities, count(DISTINCT file) AS files, (SELECT count(*) FROM cnt) AS terms, 2026 AS nowYear FROM capd")
def build_report(spark, sf_dir):
    """Written as a JSON document and read back."""
    from registrum.session import shared_path

    capped, _ = _capped(spark, sf_dir)
    _, shards, _ = _packed(spark, sf_dir)
    counts = capped.agg(F.count_distinct("lei").alias("entities"), F.count_distinct("file").alias("files")).crossJoin(shards.agg(F.count(F.lit(1)).alias("terms")))
    path = shared_path(spark, "report")
    S.write_report(spark, path, "b1", "2026-09-16", counts, nowYear=2026)
    return spark.read.schema("build string, asOf string, entities long, files long, terms long, nowYear int").json(path)


# ---- replays

_SECOND = "scored2 AS (SELECT qid, lei, prominence, (CASE WHEN n_miss = 0 THEN 2.59e0 ELSE 0e0 END) - 4.83e0 * n_miss - 0.2e0 * n_fuzzy + 2.96e0 * n_exact / n + (CASE WHEN exact THEN 0.55e0 ELSE 0e0 END) + (CASE WHEN prefix THEN 0.1e0 ELSE 0e0 END) + 1.0e0 * coverage AS match FROM f WHERE shown), hits2 AS (SELECT qid, lei, row_number() OVER (PARTITION BY qid ORDER BY match + prominence DESC, lei) AS rank FROM scored2)"
_OTHER = M.MATCH | {"fuzzy": 0.2, "prefix": 0.1, "coverage": 1.0}
_RR = "CASE WHEN {0} BETWEEN 1 AND 10 THEN 1e0 / {0} ELSE 0e0 END"


def _hits(spark, sf_dir, k, w=M.MATCH):
    names = tables.parts(spark, sf_dir)
    return M.top_k(_typed(spark, sf_dir), names, names, k, w)


def _replay(spark, sf_dir, w=M.MATCH):
    return _targets(spark, sf_dir).join(_hits(spark, sf_dir, 50, w).select("qid", "lei", "rank"), ["qid", "lei"], "left")


_BOTH = _TARGETS + f", {_SECOND}, both_runs AS (SELECT t.qid, t.stratum, t.lei, a.rank AS a, b.rank AS b FROM targets t LEFT JOIN (SELECT * FROM hits WHERE rank <= 50) a USING (qid, lei) LEFT JOIN (SELECT * FROM hits2 WHERE rank <= 50) b USING (qid, lei))"


@query("WITH " + _TYPED_SQL + ", " + _BOTH + f", st AS (SELECT stratum, count(*) AS n, avg({_RR.format('a')}) AS before, avg({_RR.format('b')}) AS after FROM both_runs GROUP BY 1), ev AS (SELECT * FROM st UNION ALL SELECT 'objective', CAST(sum(n) AS BIGINT), avg(before), avg(after) FROM st) SELECT stratum, n, round(before, 9) AS before, round(after, 9) AS after, round(after - before, 9) AS gain FROM ev")
def replay_comparison(spark, sf_dir):
    return V.compare_replays(_replay(spark, sf_dir), _replay(spark, sf_dir, _OTHER))


@query("WITH " + _TYPED_SQL + f", {_SECOND}, a AS (SELECT qid, list(lei ORDER BY rank) AS l FROM hits WHERE rank <= 10 GROUP BY 1), b AS (SELECT qid, list(lei ORDER BY rank) AS l FROM hits2 WHERE rank <= 10 GROUP BY 1) SELECT count(*) FILTER (a.l IS DISTINCT FROM b.l) AS differ, count(*) FILTER (a.l[1] IS DISTINCT FROM b.l[1]) AS first_differs FROM a FULL JOIN b USING (qid)")
def top_differences(spark, sf_dir):
    return V.top_differences(_hits(spark, sf_dir, 10), _hits(spark, sf_dir, 10, _OTHER))


_DRAW = "((('0x' || left(md5({seed} || ':' || draw || ':' || {cluster}), 8))::BIGINT) / 4294967296e0)"
_WEIGHT = "(CASE WHEN u > 0.36787944117144233 THEN 1 ELSE 0 END + CASE WHEN u > 0.7357588823428847 THEN 1 ELSE 0 END + CASE WHEN u > 0.9196986029286058 THEN 1 ELSE 0 END + CASE WHEN u > 0.9810118431238462 THEN 1 ELSE 0 END + CASE WHEN u > 0.9963401531726563 THEN 1 ELSE 0 END)"
_LIMITS = "round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high"


@query(f"WITH s AS (SELECT o_custkey, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1), d AS (SELECT *, {_DRAW.format(seed=1, cluster='o_custkey')} AS u FROM s, (SELECT unnest(range(1, 201)) AS draw)), m AS (SELECT draw, sum(s * {_WEIGHT}) / sum(n * {_WEIGHT}) AS m FROM d GROUP BY 1) SELECT round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m")
def bootstrap_ci(spark, sf_dir):
    found = V.bootstrap(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice")
    return found.select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("WITH r AS (SELECT 'one' AS system, o_orderstatus AS stratum, o_custkey AS target, (o_orderkey % 7) / 8e0 AS value FROM orders UNION ALL SELECT 'two', o_orderstatus, o_custkey, (o_orderkey % 5) / 4e0 FROM orders),"
 "s AS (SELECT system, stratum, target, sum(value) AS s, count(*) AS n FROM r GROUP BY ALL),"
 f"d AS (SELECT *, {_WEIGHT} AS w FROM (SELECT *, {_DRAW.format(seed=7, cluster='target')} AS u FROM s, (SELECT unnest(range(1, 51)) AS draw))),"
 "m AS (SELECT draw, system, stratum, sum(s * w) / sum(n * w) AS m FROM d WHERE w > 0 GROUP BY ALL UNION ALL SELECT 0, system, stratum, sum(s) / sum(n) FROM s GROUP BY ALL),"
 "e AS (SELECT * FROM m UNION ALL SELECT draw, system, 'objective', avg(m) FROM m GROUP BY 1, 2),"
 "p AS (SELECT * FROM e UNION ALL SELECT draw, 'one - two', stratum, a.m - b.m FROM (SELECT * FROM e WHERE system = 'one') a JOIN (SELECT * FROM e WHERE system = 'two') b USING (draw, stratum))"
 f"SELECT system, stratum, (SELECT round(any_value(q.m), 9) FROM p q WHERE q.draw = 0 AND q.system = p.system AND q.stratum = p.stratum) AS point, {_LIMITS} FROM p WHERE draw > 0 GROUP BY system, stratum")
def joint_intervals(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    values = {"one": (F.col("o_orderkey") % 7) / F.lit(8.0), "two": (F.col("o_orderkey") % 5) / F.lit(4.0)}
    each = F.array(*(F.struct(F.lit(n).alias("system"), v.alias("value")) for n, v in values.items()))
    return V.joint_bootstrap(o.select(F.explode(each).alias("e"), F.col("o_orderstatus").alias("stratum"), F.col("o_custkey").alias("target")).select("e.*", "stratum", "target"), draws=50)


@query("WITH s AS (SELECT o_orderstatus AS stratum, o_custkey AS target, sum((o_orderkey % 5) / 4e0 - (o_orderkey % 7) / 8e0) AS s, count(*) AS n FROM orders GROUP BY ALL),"
 f"d AS (SELECT *, {_WEIGHT} AS w FROM (SELECT *, " + _DRAW.format(seed=7, cluster="stratum || ':' || target") + " AS u FROM s, (SELECT unnest(range(1, 51)) AS draw))),"
 "m AS (SELECT draw, stratum, sum(s * w) / sum(n * w) AS m FROM d WHERE w > 0 GROUP BY ALL UNION ALL SELECT 0, stratum, sum(s) / sum(n) FROM s GROUP BY 2),"
 "e AS (SELECT * FROM m UNION ALL SELECT draw, 'objective', avg(m) FROM m GROUP BY 1)"
 f"SELECT stratum, (SELECT round(any_value(q.m), 9) FROM e q WHERE q.draw = 0 AND q.stratum = e.stratum) AS point, {_LIMITS} FROM e WHERE draw > 0 GROUP BY stratum")
def paired_intervals(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return V.paired_bootstrap(o.select(F.col("o_orderstatus").alias("stratum"), F.col("o_custkey").alias("target"), ((F.col("o_orderkey") % 7) / F.lit(8.0)).alias("before"), ((F.col("o_orderkey") % 5) / F.lit(4.0)).alias("after")), draws=50)


_SETS = "SELECT p_name AS query, CASE WHEN p_partkey % 2 = 0 THEN 'test' ELSE 'train' END AS split, CASE p_size % 4 WHEN 0 THEN 'head_label' WHEN 1 THEN 'torso' WHEN 2 THEN 'early' ELSE 'acronym' END AS stratum, CASE WHEN p_partkey % 3 = 0 THEN p_partkey || '|' || (p_partkey + 1) || '|x' ELSE CAST(p_partkey AS VARCHAR) END AS targets FROM part"


@query(_SETS)
def evaluation_rows(spark, sf_dir):
    """Sets are written as tab-separated files and read back as one."""
    from registrum.session import shared_path

    p, sets = table(spark, sf_dir, "part"), {}
    for k, (name, kind) in enumerate((("head", "label"), ("torso", "words"), ("typo", "early:swap"), ("acronyms", ""))):
        sets[name] = shared_path(spark, f"set-{name}")
        rows = p.where(F.col("p_size") % 4 == k).select(F.col("p_name").alias("query"), F.col("p_partkey").cast("string").alias("target_lei"), F.when(F.col("p_partkey") % 2 == 0, "test").otherwise("train").alias("split"), F.lit(kind).alias("qtype"), F.when(F.col("p_partkey") % 3 == 0, F.concat((F.col("p_partkey") + 1).cast("string"), F.lit("|x"))).otherwise("").alias("alt_leis"))
        rows.write.csv(sets[name], sep="\t", header=True, quote="", emptyValue="")
    return S.read_evaluation(spark, sets).withColumn("targets", F.array_join("targets", "|"))


@query("WITH " + _TYPED_SQL + "SELECT qid, len(tokens) = 1 AND length(tokens[1]) BETWEEN 2 AND 4 AS short, len(tokens) = 1 AND NOT EXISTS (SELECT 1 FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS t FROM part) x WHERE x.p_partkey = qid // 4 AND starts_with(x.t, tokens[1])) AS wordless FROM (SELECT qid * 2 + k AS qid0, qid, CASE WHEN k = 0 THEN [tokens[1]] ELSE tokens END AS tokens, k FROM typed, (VALUES (0), (1)) v(k)) WHERE k = 0")
def query_subsets(spark, sf_dir):
    q = _typed(spark, sf_dir).select("qid", F.slice("tokens", 1, 1).alias("tokens"))
    own = q.select("qid", F.floor(F.col("qid") / 4).cast("long").alias("lei"))
    none = V.without_word(q, tables.parts(spark, sf_dir), own).withColumn("wordless", F.lit(True))
    return q.join(none, "qid", "left").select("qid", V.is_short(F.col("tokens")).alias("short"), F.coalesce("wordless", F.lit(False)).alias("wordless"))


_CAUSES = _TARGETS + f""", {_POOL_SQL}, rr AS (SELECT qid, lei, row_number() OVER (PARTITION BY qid ORDER BY match + prominence DESC, lei) AS rank FROM scored JOIN pool USING (qid, lei)),
asked AS (SELECT DISTINCT qid FROM targets), rq AS (SELECT asked.qid, min(rank) AS rank FROM asked JOIN targets USING (qid) LEFT JOIN rr USING (qid, lei) GROUP BY 1),
ix AS (SELECT DISTINCT qid FROM targets WHERE lei IN (SELECT lei FROM capd)), pq AS (SELECT DISTINCT qid FROM targets JOIN pool USING (qid, lei))"""


@query("WITH RECURSIVE " + _FILES + "," + _TYPED_SQL + "," + _route_sql(True) + ", " + _CAUSES + " SELECT qid, CASE WHEN rank = 1 THEN 'first' WHEN files = '' THEN 'not routed' WHEN qid NOT IN (SELECT qid FROM ix) THEN 'not in index' WHEN qid NOT IN (SELECT qid FROM pq) THEN 'not a candidate' WHEN rank IS NULL THEN 'no name matches' ELSE 'scored low' END AS cause FROM rq JOIN routed USING (qid)")
def gap_causes(spark, sf_dir):
    bounds, capped = _bounds(spark, sf_dir)
    typed, firsts = _alike(spark, sf_dir)
    names, targets = staged(tables.parts(spark, sf_dir), "names"), _targets(spark, sf_dir)
    routed = staged(X.route(firsts, bounds), "routed")
    pool = staged(X.candidates(routed, capped), "pool")
    ranked = staged(M.top_k(firsts, names, names, 1 << 30, pool=pool), "ranked")
    asked = staged(_of_first(targets, typed), "asked")
    ranks = shuffled(asked).join(ranked.select(F.col("qid").alias("first"), "lei", "rank"), ["first", "lei"], "left").groupBy("qid").agg(F.min("rank").alias("rank"))
    held = shuffled(asked).join(pool.withColumnRenamed("qid", "first"), ["first", "lei"], "left_semi")
    every = shuffled(typed.select("qid", "first")).join(routed.withColumnRenamed("qid", "first"), "first")
    wordless = staged(V.without_word(typed, names, targets), "wordless")
    return V.causes(staged(ranks, "ranks"), every, capped, staged(held, "held"), wordless, targets)


@query("WITH " + _TYPED_SQL + "SELECT qid, qid // 4 AS expected, lei AS first, lei = qid // 4 AS ok FROM typed LEFT JOIN (SELECT * FROM hits WHERE rank = 1) USING (qid)")
def fixed_queries(spark, sf_dir):
    asked = _typed(spark, sf_dir).select("qid", F.floor(F.col("qid") / 4).cast("long").alias("expected"))
    first = _hits(spark, sf_dir, 1).select("qid", F.col("lei").alias("first"))
    return asked.join(first, "qid", "left").select("qid", "expected", "first", (F.col("first") == F.col("expected")).alias("ok"))


# ---- sessions

_FIFTIETH = "p_partkey % 50 = 0"


def _keys_sql(only: str) -> str:
    return "typed AS (SELECT p_partkey * 1000 + k AS qid, p_partkey AS session, k, k = length(p_name) AS last, string_split(trim(left(p_name, k)), ' ') AS tokens, NOT regexp_matches(left(p_name, k), '\\s$') AS in_progress FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS k FROM part" + only + "))"


def _session_sql(every_key: bool, only: str = "") -> str:
    paused, going = _route_sql(True), _route_sql(False, "_g")
    use = "p.files" if every_key else "CASE WHEN t.last THEN p.files ELSE g.files END"
    return f"""{_keys_sql(only)},{paused},{going}, used AS (SELECT t.session, t.last, t.qid, {use} AS files FROM typed t JOIN routed p USING (qid) JOIN routed_g g USING (qid)),
uf AS (SELECT session, last, qid, CAST(unnest(string_split(files, ',')) AS INTEGER) AS file FROM used WHERE files <> ''),
sz AS (SELECT file, count(*) / 4e0 AS kb FROM capd GROUP BY 1), fe AS (SELECT session, count(*) AS files, sum(kb) AS kb FROM (SELECT DISTINCT session, file FROM uf) LEFT JOIN sz USING (file) GROUP BY 1),
cn AS (SELECT session, last, qid, count(DISTINCT lei) AS n FROM uf JOIN capd USING (file) GROUP BY ALL),
cs AS (SELECT session, max(coalesce(n, 0)) AS most, coalesce(max(n) FILTER (used.last), 0) AS final FROM used LEFT JOIN cn USING (session, qid) GROUP BY 1),
costs AS (SELECT session, coalesce(files, 0) AS files, coalesce(kb, 0e0) AS kb, most, final FROM cs LEFT JOIN fe USING (session))"""


def _costs(spark, sf_dir, names, every_key: bool):
    """Costs of sessions that type each of names (session, p_name)."""
    bounds, capped = _bounds(spark, sf_dir)
    keys = V.keystrokes(names.select("session", "p_name"), "p_name")
    typed = staged(keys.select((F.col("session") * 1000 + F.col("k")).alias("qid"), "session", "k", (F.col("k") == F.length("p_name")).alias("last"), T.query_tokens(F.col("typed")).alias("tokens"), T.last_is_prefix(F.col("typed")).alias("in_progress")), "typed")
    strokes = typed.select("qid", "session", "k", "last")
    for files, paused in [("paused", True), ("typing", False)][: 1 if every_key else 2]:
        strokes = shuffled(strokes).join(staged(X.route(typed, bounds, paused=paused), "routed").withColumnRenamed("files", files), "qid")
    sizes = capped.groupBy("file").agg((F.count(F.lit(1)) / 4).alias("kb"))
    return V.session_costs(strokes, sizes, capped.select("file", "lei"), every_key=every_key)


@query("WITH RECURSIVE " + _FILES + "," + _session_sql(False, f" WHERE {_FIFTIETH}") + " SELECT session, files, kb, most, final FROM costs")
def session_costs(spark, sf_dir):
    names = table(spark, sf_dir, "part").where(_FIFTIETH).select(F.col("p_partkey").alias("session"), "p_name")
    return _costs(spark, sf_dir, names, False)


@query("WITH RECURSIVE " + _FILES + "," + _session_sql(True) + ", lg AS (SELECT 'files' AS measure, CAST(files AS DOUBLE) AS v FROM costs UNION ALL SELECT 'kb', kb FROM costs UNION ALL SELECT 'most', most FROM costs UNION ALL SELECT 'final', final FROM costs) SELECT measure, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, max(v) AS most FROM lg GROUP BY 1")
def session_cost_summary(spark, sf_dir):
    """Of the sessions of all parts. Those that type the same name cost the same: each name is typed once and counts as often as it occurs."""
    parts = table(spark, sf_dir, "part").where("p_partkey IS NOT NULL").groupBy("p_name")
    names = staged(parts.agg(F.min("p_partkey").alias("session"), F.count_distinct("p_partkey").alias("times")), "names")
    costs = shuffled(_costs(spark, sf_dir, names, True)).join(names.select("session", "times"), "session")
    return V.cost_summary(costs, "times")


# ---- the ranking's study

_CHILDREN = "kc AS (SELECT o_custkey AS lei, count(*) AS n FROM orders GROUP BY 1)"


@query("WITH " + _ENT + f", {_CHILDREN} SELECT ent.lei, round((CASE registration WHEN 'ISSUED' THEN 15e0 WHEN 'LAPSED' THEN 4e0 ELSE 0e0 END) - 45e0 * (CASE WHEN entity_status <> 'ACTIVE' OR registration IN ('RETIRED', 'ANNULLED', 'DUPLICATE') THEN 1 ELSE 0 END) + greatest(0e0, 14e0 - length(name) / 6e0) + least(coalesce(kc.n, 0), 60) * 1.2e0, 9) AS score FROM ent LEFT JOIN kc USING (lei)")
def baseline_scores(spark, sf_dir):
    kids = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("lei")).agg(F.count(F.lit(1)).alias("n_children"))
    e = tables.entities(spark, sf_dir).withColumn("name_length", F.char_length("name")).join(kids, "lei", "left").na.fill(0, ["n_children"])
    return e.select("lei", F.round(R.baseline_score(), 9).alias("score"))


_SIGNALS = """sig AS (SELECT c_custkey AS lei, coalesce(d.n, 0) AS n_managed, coalesce(i.n, 0) AS isin, c_nationkey IN (SELECT s_nationkey FROM supplier) AS bic, c_custkey IN (SELECT l_suppkey FROM lineitem) AS mic, coalesce(k.n, 0) AS sitelinks
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE left(o_orderpriority, 1) NOT IN ('1', '2', '3') GROUP BY 1) d ON d.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) i ON i.o_custkey = c_custkey
LEFT JOIN (SELECT user_id, max(CAST(round(value) AS INTEGER)) AS n FROM events GROUP BY 1) k ON k.user_id = c_custkey)"""


def _signals(spark, sf_dir):
    e = tables.entities(spark, sf_dir).select("lei", "category")
    counts = R.all_relations(tables.relations(spark, sf_dir), {"n_managed": "IS_SUBFUND_OF"})
    mics = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("lei"))
    links = table(spark, sf_dir, "events").select(F.col("user_id").alias("lei"), F.round("value").cast("int").alias("sitelinks"))
    return R.joined_signals(e, counts, tables.isins(spark, sf_dir), {"bic": tables.bics(spark, sf_dir), "mic": mics}, links)


@query("WITH " + _SIGNALS + " SELECT lei, n_managed, isin, bic, mic, sitelinks FROM sig")
def research_signals(spark, sf_dir):
    return _signals(spark, sf_dir).select("lei", "n_managed", "isin", "bic", "mic", "sitelinks")


@query("WITH " + _SIGNALS + " SELECT lei, round(0.3e0 * ln(1 + n_managed) + 0.2e0 * ln(1 + sitelinks), 9) AS extra FROM sig")
def extra_prominence(spark, sf_dir):
    return _signals(spark, sf_dir).select("lei", F.round(R.extra_prominence({"managed": 0.3, "wikidata": 0.2, "sole": 1.0}), 9).alias("extra"))


@query("SELECT DISTINCT o_orderkey AS child, o_custkey AS parent FROM orders WHERE left(o_orderpriority, 1) IN ('1', '2') AND o_orderkey IN (SELECT c_custkey FROM customer) AND o_custkey IN (SELECT c_custkey FROM customer)")
def consolidated_pairs(spark, sf_dir):
    return R.consolidated_pairs(tables.relations(spark, sf_dir), tables.entities(spark, sf_dir))


@query("SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS event_type, string_agg(DISTINCT props, '|' ORDER BY props) AS props FROM events GROUP BY 1")
def item_details(spark, sf_dir):
    return R.item_details(table(spark, sf_dir, "events"), "user_id", ["event_type", "props"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS lei, c_name AS name, CASE WHEN c_acctbal < 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status FROM customer")
def entity_extract(spark, sf_dir):
    """Written as a tab-separated file and read back."""
    lines = R.extract(tables.entities(spark, sf_dir), {"lei": "lei", "name": "name", "status": "entity_status"})
    return spark.read.parquet(written(lines, "extract"))


_OLD_ROUTE = """old AS (SELECT qid, p - 1 AS pos, tokens[p] AS word, in_progress AND p = len(tokens) AS open FROM (SELECT qid, tokens, in_progress, unnest(range(1, len(tokens) + 1)) AS p FROM typed)),
o1 AS (SELECT old.*, coalesce(tb.file, 0) AS first FROM old ASOF LEFT JOIN tb ON old.word >= tb.lo), o2 AS (SELECT x.*, coalesce(tb.file, 0) AS last FROM (SELECT *, word || chr(65535) AS far FROM o1) x ASOF LEFT JOIN tb ON x.far >= tb.lo),
o3 AS (SELECT qid, pos, unnest(range(first, CASE WHEN open THEN least(last, first + 1) ELSE first END + 1)) AS file FROM o2)"""


@query("WITH RECURSIVE " + _FILES + "," + _TYPED_SQL + "," + _OLD_ROUTE + " SELECT qid, string_agg(CAST(file AS VARCHAR), ',' ORDER BY pos, file) AS files FROM (SELECT qid, file, min(pos) AS pos FROM o3 GROUP BY 1, 2) GROUP BY 1")
def route_merged(spark, sf_dir):
    return R.route_words(staged(_typed(spark, sf_dir), "typed"), _bounds(spark, sf_dir)[0]).select("qid", F.array_join("files", ",").alias("files"))


@query("WITH RECURSIVE " + _FILES + "," + _TYPED_SQL + "," + _OLD_ROUTE + ", lw AS (SELECT qid, arg_max(pos, (length(word), -pos)) AS pos FROM old GROUP BY 1) SELECT qid, string_agg(CAST(file AS VARCHAR), ',' ORDER BY file) AS files FROM o3 JOIN lw USING (qid, pos) GROUP BY 1")
def route_longest(spark, sf_dir):
    return R.route_words(staged(_typed(spark, sf_dir), "typed"), _routing(spark, sf_dir), "longest").select("qid", F.array_join("files", ",").alias("files"))


@query("WITH RECURSIVE " + _FILES + "," + _TYPED_SQL + "," + _route_sql(True) + " SELECT 1 AS span, qid, files FROM routed")
def routing_grid(spark, sf_dir):
    """The grid holds the shipped limits; wider ones are held against it in the tests."""
    found = R.route_grid(staged(_typed(spark, sf_dir), "typed"), _routing(spark, sf_dir), [(3, 1, 2)])
    return found.select("span", "qid", F.array_join("files", ",").alias("files"))


@query("""WITH RECURSIVE cnt AS (SELECT term, count(*) AS cnt FROM (SELECT DISTINCT p_partkey AS lei, unnest(string_split(p_name || ' ' || lower(replace(p_brand, '#', ' ')) || ' ' || lower(p_type), ' ')) AS term FROM part) WHERE length(term) >= 2 GROUP BY 1),
cut AS (SELECT term, cnt, left(term, i) AS prefix FROM (SELECT term, cnt, unnest(range(2, least(length(term), 14) + 1)) AS i FROM cnt)), sums AS (SELECT prefix, sum(cnt) AS total FROM cut GROUP BY 1),
fit AS (SELECT term, arg_min(prefix, length(prefix)) AS shard FROM cut JOIN sums USING (prefix) WHERE total <= 200 OR length(prefix) = 14 GROUP BY 1), sh AS (SELECT term, coalesce(shard, term) AS shard, shard IS NULL AS alone FROM cnt LEFT JOIN fit USING (term)),
gs AS (SELECT shard, alone, min(term) AS lo, count(*) AS n, row_number() OVER (ORDER BY min(term)) AS i FROM sh GROUP BY 1, 2),
pk AS (SELECT i, CAST(0 AS BIGINT) AS file, n AS held FROM gs WHERE i = 1 UNION ALL SELECT g.i, CASE WHEN pk.held > 3 THEN pk.file + 1 ELSE pk.file END, CASE WHEN pk.held > 3 THEN g.n ELSE pk.held + g.n END FROM pk JOIN gs g ON g.i = pk.i + 1)
SELECT shard, alone, CAST(file AS INTEGER) AS file, lo FROM gs JOIN pk USING (i)""")
def packed_by_words(spark, sf_dir):
    return R.pack_by_words(_packed(spark, sf_dir)[1], 3)


@query("WITH " + _TYPED_SQL + ", " + _RANKED + "SELECT stratum, n, mrr, round(s10, 9) AS s10 FROM ql WHERE stratum <> 'head'")
def without_stratum(spark, sf_dir):
    """The measures of a slice, here of all strata but one."""
    return V.quality(_ranks(spark, sf_dir).where("stratum <> 'head'")).select("stratum", "n", "mrr", "s10")


@query("SELECT 'elf' AS list, CAST(n_nationkey AS VARCHAR) AS code, n_name AS name FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT 'ra', CAST(r_regionkey AS VARCHAR), r_name FROM region")
def read_codes(spark, sf_dir):
    """Code lists written as an index's document and read back."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.col("n_name")).alias("name"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("code"), F.col("r_name").alias("name"))
    listed = lambda df: df.agg(F.map_from_entries(F.collect_list(F.struct("code", "name"))).alias("codes"))
    document = listed(n).select(F.col("codes").alias("elf")).crossJoin(listed(r).select(F.col("codes").alias("ra"))).select(F.to_json(F.struct("elf", "ra")).alias("value"))
    from registrum.session import shared_path

    path = shared_path(spark, "codes")
    document.coalesce(1).write.text(path)
    return S.read_codes(spark, path)


@query("WITH RECURSIVE " + _FILES + "," + _TYPED_SQL + "," + _route_sql(True) + ", " + _TARGETS + f""", {_POOL_SQL}, asked AS (SELECT qid, stratum, min(rank) AS rank FROM targets LEFT JOIN (SELECT * FROM hits WHERE rank <= 50) h USING (qid, lei) GROUP BY ALL),
near AS (SELECT qid, min(rank) AS other FROM (SELECT qid, lei + d AS lei FROM targets, (VALUES (-1), (1)) v(d)) JOIN (SELECT * FROM hits WHERE rank <= 50) h USING (qid, lei) GROUP BY 1), held AS (SELECT DISTINCT qid FROM targets JOIN pool USING (qid, lei))
SELECT stratum, round(avg(CASE WHEN held.qid IS NULL THEN 0e0 ELSE 1e0 END), 9) AS in_pool, round(avg(CASE WHEN least(rank, other) <= 10 THEN 1e0 / least(rank, other) ELSE 0e0 END), 9) AS lenient FROM asked LEFT JOIN near USING (qid) LEFT JOIN held USING (qid) GROUP BY 1""")
def pooled_quality(spark, sf_dir):
    bounds, capped = _bounds(spark, sf_dir)
    typed, firsts = _alike(spark, sf_dir)
    names, targets = staged(tables.parts(spark, sf_dir), "names"), _targets(spark, sf_dir)
    pool = staged(X.candidates(staged(X.route(firsts, bounds), "routed"), capped), "pool")
    hits = staged(M.top_k(firsts, names, names, 50), "hits").select(F.col("qid").alias("first"), "lei", "rank")
    asked = staged(_of_first(targets, typed), "asked")
    near = asked.select("qid", "first", F.explode(F.array(F.col("lei") - 1, F.col("lei") + 1)).alias("lei"))
    own, beside = (staged(shuffled(df).join(hits, ["first", "lei"]).select("qid", "lei", "rank"), "found") for df in (asked, near))
    held = staged(shuffled(asked).join(pool.withColumnRenamed("qid", "first"), ["first", "lei"], "left_semi"), "held")
    return V.pooled_quality(V.target_ranks(own, targets), beside, held, targets)


@query("SELECT '| check | value | result |' || chr(10) || '| - | - | - |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' | ' || CASE WHEN n_regionkey > 1 THEN 'ok' ELSE 'FAILED' END || ' |', chr(10) ORDER BY n_regionkey > 1, n_name) AS \"table\" FROM nation")
def check_table(spark, sf_dir):
    from registrum.operators.publish import check_table as told

    return told(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("value"), (F.col("n_regionkey") > 1).alias("ok")))
