"""Queries over the driver's tables, and the SQL that each must equal."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from registrum.functions import identifiers as I
from registrum.functions import numeric as N
from registrum.functions import text as T
from registrum.operators import entities as E
from registrum.operators import evaluate as V
from registrum.operators import index as X
from registrum.operators import match as M
from registrum.operators import publish as P
from registrum.operators.joins import shuffled
from registrum.plans import tables
from registrum.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from registrum.plans.tables import table
from registrum.session import staged, written
from registrum.streaming import sessions as S

COUNTRIES = ["US", "SE", "CS", "DE", "GB", "FR", "NL"]


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is typed: the name of every fiftieth part as it is, without its last two letters, and with two letters swapped."""
    name, id_ = F.col("p_name"), F.col("p_partkey")
    swapped = F.concat(F.left(name, F.lit(1)), F.substring(name, 3, 1), F.substring(name, 2, 1), F.substr(name, F.lit(4), F.lit(1_000)))
    kinds = F.array(name, F.left(name, F.length(name) - 2), swapped)
    rows = table(spark, sf_dir, "part").where(id_ % 50 == 0).select(id_, F.posexplode(kinds).alias("k", "query")).select((id_ * 4 + F.col("k")).alias("qid"), "query")
    return rows.select("qid", "query", T.query_tokens(F.col("query")).alias("tokens"), T.last_is_prefix(F.col("query")).alias("in_progress"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


_STOP = ", ".join(f"'{w}'" for w in "the of and de du des la le les der die das und et y for in van von di del da do a an".split())
_TYPED_SQL = f"""
typed AS (SELECT qid, query, string_split(trim(query), ' ') AS tokens, NOT regexp_matches(query, '\\s$') AS in_progress FROM (SELECT p_partkey * 4 + k AS qid, CASE k WHEN 0 THEN p_name WHEN 1 THEN left(p_name, length(p_name) - 2) ELSE left(p_name, 1) || substr(p_name, 3, 1) || substr(p_name, 2, 1) || substr(p_name, 4) END AS query FROM part, (VALUES (0), (1), (2)) v(k) WHERE p_partkey % 50 = 0)),
q AS (SELECT qid, tokens, len(tokens) AS n, unnest(range(1, len(tokens) + 1)) AS p FROM typed),
w AS (SELECT qid, tokens, n, p, tokens[p] AS q, len(list_filter(tokens, lambda x: x NOT IN ({_STOP}))) = 0 AS all_stop FROM q),
names AS (SELECT p_partkey AS lei, string_split(p_name, ' ') AS seq, round(p_retailprice / 1000, 1) AS prominence FROM part),
t AS (SELECT lei, seq, unnest(range(1, len(seq) + 1)) AS pos FROM names),
vocab AS (SELECT DISTINCT seq[pos] AS t FROM t),
lv AS (SELECT q, t, CASE WHEN q = t THEN 3 WHEN starts_with(t, q) THEN 2 WHEN length(q) >= 4 AND len(list_filter([length(q) - 1, length(q), length(q) + 1], lambda j: j <= length(t) AND damerau_levenshtein(q, left(t, j)) <= 1)) > 0 THEN 1 ELSE 0 END AS level FROM (SELECT DISTINCT q FROM w), vocab),
m AS (SELECT w.qid, t.lei, w.p, w.q, w.all_stop OR w.q NOT IN ({_STOP}) AS content, max(level) AS level, arg_min(t.pos, (-level, t.pos)) AS pos
  FROM w JOIN lv USING (q) JOIN t ON t.seq[t.pos] = lv.t WHERE level > 0 GROUP BY ALL),
s AS (SELECT qid, lei, bool_or(content) AS shown, count(*) FILTER (content) AS n_content, count(*) FILTER (level = 1) AS n_fuzzy, count(*) FILTER (level = 3) AS n_exact, count(DISTINCT pos) AS n_pos FROM m GROUP BY ALL),
need AS (SELECT qid, count(*) FILTER (all_stop OR q NOT IN ({_STOP})) AS n_needed FROM w GROUP BY 1),
f AS (SELECT qid, lei, len(tokens) AS n, shown, n_needed - n_content AS n_miss, n_fuzzy, n_exact, tokens = seq AS exact, prominence,
    len(tokens) <= len(seq) AND tokens[:len(tokens) - 1] = seq[:len(tokens) - 1] AND starts_with(seq[len(tokens)], tokens[len(tokens)]) AS prefix, n_pos / greatest(1, len(seq)) AS coverage
  FROM s JOIN typed USING (qid) JOIN need USING (qid) JOIN names USING (lei)),
scored AS (SELECT qid, lei, prominence, (CASE WHEN n_miss = 0 THEN 2.59e0 ELSE 0e0 END) - 4.83e0 * n_miss - 1.19e0 * n_fuzzy + 2.96e0 * n_exact / n + (CASE WHEN exact THEN 0.55e0 ELSE 0e0 END) + (CASE WHEN prefix THEN 0.84e0 ELSE 0e0 END) + 2.26e0 * coverage AS match FROM f WHERE shown),
hits AS (SELECT qid, lei, match + prominence AS score, row_number() OVER (PARTITION BY qid ORDER BY match + prominence DESC, lei) AS rank FROM scored)
"""


@query("WITH " + _TYPED_SQL + "SELECT qid, lei, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hits WHERE rank <= 10")
def flagship_search(spark, sf_dir):
    names = tables.parts(spark, sf_dir)
    return M.top_k(_typed(spark, sf_dir), names, names, 10)


@query("WITH " + _TYPED_SQL + "SELECT qid, lei, n, shown, n_miss, n_fuzzy, n_exact, exact, prefix, round(coverage, 6) AS coverage FROM f")
def match_features(spark, sf_dir):
    typed, names = staged(_typed(spark, sf_dir), "typed"), staged(tables.parts(spark, sf_dir), "names")
    shown = ("n", "shown", "n_miss", "n_fuzzy", "n_exact", "exact", "prefix")
    found = staged(M.text_features(typed, names).select("text", "shape", *shown, F.round("coverage", 6).alias("coverage")), "features")
    texts = staged(M.gathered(typed.select("qid", M.query_text().alias("text")), "text", "qid"), "texts")
    owners = staged(M.gathered(M.owners(names), "shape", "lei"), "owners")
    return M.for_everyone(found, texts, owners)


@query("WITH " + _TYPED_SQL + "SELECT q, t, level FROM lv WHERE level > 0")
def match_level(spark, sf_dir):
    q = _typed(spark, sf_dir).select(F.explode("tokens").alias("q"))
    return M.vocabulary_levels(q, tables.parts(spark, sf_dir).select(F.explode("seq").alias("t")))


#: Every part is a target: of the query of the last fiftieth part up to it, whole, cut or misspelt in turn.
_TARGETS = "targets AS (SELECT greatest(p_partkey // 50 * 50, 50) * 4 + p_partkey % 3 AS qid, CASE WHEN p_size % 3 = 0 THEN 'head' WHEN p_size % 3 = 1 THEN 'torso' ELSE 'tail' END AS stratum, p_partkey AS lei FROM part)"
_RANKED = _TARGETS + ", r AS (SELECT qid, stratum, min(rank) AS rank FROM targets LEFT JOIN (SELECT * FROM hits WHERE rank <= 50) h USING (qid, lei) GROUP BY ALL), ql AS (SELECT stratum, count(*) AS n, round(avg(CASE WHEN rank <= 10 THEN 1 / rank ELSE 0 END), 9) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 9) AS s1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 9) AS s5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 9) AS s10 FROM r GROUP BY 1) "


def _targets(spark, sf_dir):
    kind, id_ = F.col("p_size") % 3, F.col("p_partkey")
    qid = F.greatest(F.floor(id_ / 50) * 50, F.lit(50)) * 4 + id_ % 3
    return table(spark, sf_dir, "part").select(qid.cast("long").alias("qid"), F.when(kind == 0, "head").when(kind == 1, "torso").otherwise("tail").alias("stratum"), id_.alias("lei"))


def _ranks(spark, sf_dir):
    names = tables.parts(spark, sf_dir)
    return V.target_ranks(M.top_k(_typed(spark, sf_dir), names, names, 50), _targets(spark, sf_dir))


@query("WITH " + _TYPED_SQL + ", " + _RANKED + "SELECT stratum, n, mrr, s1, s5, s10 FROM ql")
def mrr_by_stratum(spark, sf_dir):
    return V.quality(_ranks(spark, sf_dir))


@query("WITH " + _TYPED_SQL + ", " + _RANKED + "SELECT round(avg(mrr), 9) AS objective FROM ql")
def objective(spark, sf_dir):
    return V.objective(V.quality(_ranks(spark, sf_dir)))


@query("WITH " + _TYPED_SQL + ", " + _RANKED + "SELECT qid, stratum, CASE WHEN rank IS NULL THEN 'not found' WHEN rank = 1 THEN 'first' WHEN rank <= 10 THEN 'page' ELSE 'beyond' END AS cause FROM r")
def miss_causes(spark, sf_dir):
    cause = F.when(F.col("rank").isNull(), "not found").when(F.col("rank") == 1, "first").when(F.col("rank") <= 10, "page").otherwise("beyond")
    return _ranks(spark, sf_dir).select("qid", "stratum", cause.alias("cause"))


_FOLD = "lower(strip_accents(replace(replace(replace(replace({0}, 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), 'Œ', 'oe')))"


@query(f"SELECT doc_id, sha256({_FOLD.format('text')}) AS folded FROM documents")
def fold_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("folded"))


@query(f"""
WITH c AS (SELECT doc_id, p, list_filter(regexp_split_to_array({_FOLD.format('text')}, '\\s+'), lambda x: x <> '')[p] AS c FROM (SELECT doc_id, text, unnest(range(1, len(list_filter(regexp_split_to_array({_FOLD.format('text')}, '\\s+'), lambda x: x <> '')) + 1)) AS p FROM documents)),
r AS (SELECT doc_id, p, regexp_extract_all(c, '[a-z0-9]+') AS runs FROM c),
s AS (SELECT doc_id, p, unnest(CASE WHEN len(runs) >= 2 AND len(list_filter(runs, lambda x: length(x) > 2)) = 0 THEN [array_to_string(runs, '')] ELSE runs END) AS w, unnest(range(0, CASE WHEN len(runs) >= 2 AND len(list_filter(runs, lambda x: length(x) > 2)) = 0 THEN 1 ELSE len(runs) END)) AS k FROM r),
o AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) AS i FROM s),
g AS (SELECT doc_id, w, i, sum(CASE WHEN length(w) = 1 AND lag_len = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM (SELECT *, lag(length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS lag_len FROM o)),
m AS (SELECT doc_id, grp, string_agg(w, '' ORDER BY i) AS token FROM g GROUP BY 1, 2)
SELECT doc_id, count(*) AS n, sha256(string_agg(token, ' ' ORDER BY grp)) AS tokens FROM m GROUP BY 1
""")
def name_tokens(spark, sf_dir):
    # dealt out of an array of one: a plain projection would be worked out again for each use of it
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(T.name_seq(F.col("text")))).alias("seq"))
    return d.where(F.size("seq") > 0).select("doc_id", F.size("seq").cast("long").alias("n"), F.sha2(F.array_join("seq", " "), 256).alias("tokens"))


#: Fixed values of the query: the letters a to z and their full-width forms.
_NARROW, _WIDE = "".join(map(chr, range(97, 123))), "".join(map(chr, range(0xFF41, 0xFF5B)))


@query("SELECT p_partkey, lower(p_name) || ' finance flow xii co ' || p_size AS folded, sha256(array_to_string(list_concat(string_split(lower(p_name), ' '), ['finance', 'flow', 'xii', 'co', CAST(p_size AS VARCHAR)]), ' ')) AS tokens FROM part")
def folded_names(spark, sf_dir):
    name = F.concat(F.translate("p_name", _NARROW, _WIDE), F.lit("\u3000\ufb01nance\u2009\ufb02ow\u00a0\u216b\u2028C\u2134\u0301 "), F.col("p_size").cast("string"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(name)).alias("name"))
    spaces = F.regexp_replace(T.fold(F.col("name")), T.SPACE + "+", " ")
    return p.select("p_partkey", spaces.alias("folded"), F.sha2(F.array_join(T.query_tokens(F.col("name")), " "), 256).alias("tokens"))


_FORMS = (("AB (publ)", "ab publ"), ("GmbH & Co. KG", "gmbh co kg"), ("Limited", "limited"), ("P.L.C.", "plc"), ("", ""))


@query(f"""WITH n AS (SELECT c_custkey, lower(c_mktsegment) AS w, [{", ".join(f"'{tokens}'" for _, tokens in _FORMS)}][c_custkey % 5 + 1] AS form FROM customer)
SELECT c_custkey, trim(w || ' coca cola of ' || form) AS seq, 'cocacola' || CASE WHEN c_custkey % 5 = 3 THEN '' ELSE '' END AS extras, 4 AS start,
  left(w, 1) || 'cc' || CASE WHEN c_custkey % 5 = 1 THEN ' ' || left(w, 1) || 'ccg' WHEN c_custkey % 5 = 2 THEN ' ' || left(w, 1) || 'ccl' ELSE '' END AS initials FROM n""")
def name_forms(spark, sf_dir):
    form = F.get(F.array(*(F.lit(f) for f, _ in _FORMS)), (F.col("c_custkey") % 5).cast("int"))
    name = F.concat("c_mktsegment", F.lit(" Coca-Cola of "), form)
    d = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")).select("c_custkey", F.explode(F.array(F.struct(T.name_seq(F.col("name")).alias("seq"), T.name_extras(F.col("name")).alias("extras")))).alias("n")).select("c_custkey", "n.*")
    d = d.withColumn("start", T.form_start(F.col("seq")))
    listed = lambda c: F.array_join(c, " ")
    shown = F.filter("extras", lambda x: F.length(x) > 3)
    return d.select("c_custkey", listed("seq").alias("seq"), listed(shown).alias("extras"), "start", listed(T.name_initials(F.col("seq"), F.col("start"))).alias("initials"))


_LEI = "CASE WHEN regexp_full_match({0}, '[0-9A-Z]{{18}}[0-9]{{2}}') THEN CAST(array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), '') AS HUGEINT) % 97 = 1 ELSE false END"


_CODES = """codes AS (SELECT c_custkey, CASE c_custkey % 7
  WHEN 0 THEN lpad(CAST(c_custkey AS VARCHAR), 18, '0') || lpad(CAST(98 - CAST(c_custkey AS HUGEINT) * 100 % 97 AS VARCHAR), 2, '0')
  WHEN 1 THEN lpad(CAST(c_custkey AS VARCHAR), 18, '0') || '00' WHEN 2 THEN 'US' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || CAST(c_custkey // 7 % 10 AS VARCHAR)
  WHEN 3 THEN 'abcd' || CASE WHEN c_custkey % 2 = 0 THEN 'us' ELSE 'xx' END || '2l' WHEN 4 THEN '55' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '-0680'
  WHEN 5 THEN 'ABCD US 33 XXX' ELSE c_name END AS code FROM customer),
known AS (SELECT c_custkey, code, upper(replace(code, ' ', '')) AS c FROM codes),
luhn AS (SELECT *, regexp_full_match(c, '[A-Z]{2}[0-9A-Z]{9}[0-9]') AS shaped, string_split('3028' || substr(c, 3), '') AS d FROM known),
ids AS (SELECT c_custkey, code, c, CASE WHEN regexp_full_match(c, '[0-9]{20}') THEN CAST(c AS HUGEINT) % 97 = 1 ELSE false END AS is_lei,
  CASE WHEN shaped THEN list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 1 THEN CAST(d[i] AS INTEGER) * 2 // 10 + CAST(d[i] AS INTEGER) * 2 % 10 ELSE CAST(d[i] AS INTEGER) END)) % 10 = 0 ELSE false END AS is_isin,
  regexp_full_match(c, '[0-9A-Z]{4}[A-Z]{2}[0-9A-Z]{2}([0-9A-Z]{3})?') AND substr(c, 5, 2) IN ('US','SE','CS','DE','GB','FR','NL') AS is_bic,
  CASE WHEN c_custkey % 7 = 4 THEN code END AS register FROM luhn)"""


def _codes(spark, sf_dir):
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    check = (98 - (k.cast("decimal(38,0)") * 100) % 97).cast("int").cast("string")
    code = (
        F.when(k % 7 == 0, F.concat(F.lpad(text, 18, "0"), F.lpad(check, 2, "0"))).when(k % 7 == 1, F.concat(F.lpad(text, 18, "0"), F.lit("00")))
        .when(k % 7 == 2, F.concat(F.lit("US"), F.lpad(text, 9, "0"), (F.floor(k / 7) % 10).cast("string"))).when(k % 7 == 3, F.concat(F.lit("abcd"), F.when(k % 2 == 0, "us").otherwise("xx"), F.lit("2l")))
        .when(k % 7 == 4, F.concat(F.lit("55"), F.lpad(text, 9, "0"), F.lit("-0680"))).when(k % 7 == 5, "ABCD US 33 XXX").otherwise(F.col("c_name"))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", code.alias("code"))


@query(f"WITH {_CODES} SELECT c_custkey, is_lei AND code = c AS lei, is_isin AND code = c AS isin, is_bic AND code = c AS bic FROM ids")
def valid_codes(spark, sf_dir):
    code = F.col("code")
    return _codes(spark, sf_dir).select("c_custkey", I.valid_lei(code).alias("lei"), I.valid_isin(code).alias("isin"), I.valid_bic(code, COUNTRIES).alias("bic"))


@query(f"WITH {_CODES} SELECT c_custkey, CASE WHEN is_lei THEN c END AS lei, CASE WHEN is_isin THEN c END AS isin, CASE WHEN is_bic THEN c END AS bic, register FROM ids")
def identifier_readings(spark, sf_dir):
    d = _codes(spark, sf_dir)
    return d.select("c_custkey", I.readings(F.col("code"), COUNTRIES).alias("r"), I.register_number(F.col("code")).alias("register")).select("c_custkey", "r.*", "register")


_ENT = """
first AS (SELECT o_custkey AS lei, min(o_orderdate) AS d FROM orders GROUP BY 1),
ent AS (SELECT c_custkey AS lei, c_name AS name, CASE WHEN c_acctbal < 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS entity_status, ['ISSUED', 'LAPSED', 'PENDING_TRANSFER', 'PENDING_ARCHIVAL', 'RETIRED', 'DUPLICATE', 'ANNULLED', 'MERGED'][c_custkey % 8 + 1] AS registration, c_mktsegment = 'FURNITURE' AS fund, c_nationkey, year(d) + (month(d) - 1) / 12 AS registered_year FROM customer LEFT JOIN first ON c_custkey = lei),
rel AS (SELECT o_orderkey AS child, o_custkey AS parent, left(o_orderpriority, 1) AS kind, o_orderstatus <> 'P' AS active FROM orders),
pc AS (SELECT parent AS lei, count(*) FILTER (kind = '1') AS n_direct, count(*) FILTER (kind = '2') AS n_ultimate, count(*) FILTER (kind = '3') AS n_branch FROM rel WHERE active AND kind IN ('1', '2', '3') GROUP BY 1),
hp AS (SELECT DISTINCT child FROM rel WHERE active AND kind IN ('1', '2')),
isin AS (SELECT o_custkey AS lei, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
"""


@query("WITH " + _ENT + "SELECT lei AS parent, n_direct, n_ultimate, n_branch FROM pc")
def parent_counts(spark, sf_dir):
    return E.parent_counts(tables.relations(spark, sf_dir))


@query("WITH " + _ENT + "SELECT child FROM hp")
def has_parent(spark, sf_dir):
    return E.has_parent(tables.relations(spark, sf_dir))


@query("WITH " + _ENT + "SELECT lei, n FROM isin")
def isin_counts(spark, sf_dir):
    return E.key_counts(tables.isins(spark, sf_dir), "lei")


@query("SELECT c_custkey AS lei FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def bic_flag(spark, sf_dir):
    return tables.bics(spark, sf_dir)


@query("SELECT parent, count(*) FILTER (kind = '1') AS direct, count(*) FILTER (kind = '2') AS ultimate, count(*) FILTER (kind = '3') AS branch FROM (SELECT o_custkey AS parent, left(o_orderpriority, 1) AS kind FROM orders) GROUP BY 1")
def relationship_pivot(spark, sf_dir):
    r = tables.relations(spark, sf_dir)
    kinds = ["IS_DIRECTLY_CONSOLIDATED_BY", "IS_ULTIMATELY_CONSOLIDATED_BY", "IS_INTERNATIONAL_BRANCH_OF"]
    out = r.groupBy("parent").pivot("type", kinds).count().na.fill(0)
    return out.select("parent", *(F.col(k).alias(n) for k, n in zip(kinds, ("direct", "ultimate", "branch"), strict=True)))


_TERM = "CAST(CAST({0} AS FLOAT) * CAST({1} AS FLOAT) AS FLOAT)"


def _prominence_sql() -> str:
    dead = "(entity_status <> 'ACTIVE' OR registration IN ('RETIRED', 'DUPLICATE', 'ANNULLED', 'MERGED'))"
    flag = lambda c: f"(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)"
    kids = "greatest(coalesce(n_direct, 0), coalesce(n_ultimate, 0))"
    parent = "(child IS NOT NULL)"
    years = "least(greatest(coalesce(CAST(CAST(2026.74 AS FLOAT) - CAST(registered_year AS FLOAT) AS FLOAT), 0), 0), 15)"
    terms = [("-0.39", flag(f"NOT {dead} AND registration = 'LAPSED'")), ("0.32", flag("fund")), ("0.0", "0.0"), ("0.5", f"ln(1 + {kids})"), ("1.36", flag(f"{kids} > 0 AND NOT {parent}")), ("-0.56", flag(parent)), ("-0.91", "ln(1 + coalesce(n_branch, 0))"), ("0.49", "least(CAST(ln(1 + coalesce(isin.n, 0)) AS FLOAT), CAST(3.932 AS FLOAT))"), ("0.74", flag("bic")), ("2.46", f"CAST({years} / 10 AS FLOAT)"), ("-1.01", "ln(greatest(length(name), 1))")]
    total = _TERM.format("-2.9", flag(dead))
    for w, x in terms:
        total = f"CAST({total} + {_TERM.format(w, x)} AS FLOAT)"
    return total


@query("WITH " + _ENT + f"""SELECT lei, CAST(floor(CAST({_prominence_sql()} AS DOUBLE) * 10 + 0.5) AS BIGINT) AS tenths
FROM (SELECT ent.*, c_nationkey IN (SELECT s_nationkey FROM supplier) AS bic FROM ent) e LEFT JOIN pc USING (lei) LEFT JOIN hp ON hp.child = e.lei LEFT JOIN isin USING (lei)""")
def prominence_tenths(spark, sf_dir):
    e = E.with_signals(tables.entities(spark, sf_dir), tables.relations(spark, sf_dir), tables.isins(spark, sf_dir), tables.bics(spark, sf_dir), 2026.74)
    return e.select("lei", N.stored_tenths(F.col("prominence")).alias("tenths"))


@query("WITH " + _ENT + "SELECT lei, CASE WHEN entity_status = 'INACTIVE' THEN lower(l) ELSE l END AS letter FROM (SELECT *, ['I', 'L', 'T', 'P', 'R', 'D', 'A', 'M'][lei % 8 + 1] AS l FROM ent)")
def status_letters(spark, sf_dir):
    return tables.entities(spark, sf_dir).select("lei", E.status_letter(F.col("registration"), F.col("entity_status")).alias("letter"))


_BAD = "SELECT CASE WHEN c_custkey % 11 = 0 THEN 'short' ELSE lpad(CAST(c_custkey AS VARCHAR), 20, '0') END AS lei, CASE WHEN c_custkey % 13 = 0 THEN 'x' ELSE 'SE' END AS country, CASE WHEN c_custkey % 17 = 0 THEN 'NEW' ELSE 'ISSUED' END AS registration, CASE WHEN c_custkey % 19 = 0 THEN ' ' ELSE c_name END AS name FROM customer"


@query(f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT regexp_full_match(lei, '[0-9A-Z]{{20}}') THEN 'bad LEI' WHEN NOT regexp_full_match(country, '[A-Z]{{2}}') THEN 'bad country' WHEN registration = 'NEW' THEN 'unknown status' WHEN trim(name) = '' THEN 'empty name' END AS reason FROM ({_BAD})) WHERE reason IS NOT NULL GROUP BY 1")
def skip_reasons(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.when(k % 11 == 0, "short").otherwise(F.lpad(k.cast("string"), 20, "0")).alias("lei"), F.when(k % 13 == 0, "x").otherwise("SE").alias("country"),
        F.when(k % 17 == 0, "NEW").otherwise("ISSUED").alias("registration"), F.when(k % 19 == 0, " ").otherwise(F.col("c_name")).alias("name"),
    )
    return E.skip_counts(rows)


_POSTINGS = "post AS (SELECT DISTINCT p_partkey AS lei, unnest(string_split(p_name || ' ' || lower(replace(p_brand, '#', ' ')) || ' ' || lower(p_type), ' ')) AS term FROM part), cnt AS (SELECT term, count(*) AS cnt FROM post WHERE length(term) >= 2 GROUP BY 1)"
_SHARDS = _POSTINGS + """, cut AS (SELECT term, cnt, left(term, i) AS prefix FROM (SELECT term, cnt, unnest(range(2, least(length(term), 14) + 1)) AS i FROM cnt)),
sums AS (SELECT prefix, sum(cnt) AS total FROM cut GROUP BY 1),
fit AS (SELECT term, arg_min(prefix, length(prefix)) AS shard FROM cut JOIN sums USING (prefix) WHERE total <= 200 OR length(prefix) = 14 GROUP BY 1),
sh AS (SELECT term, cnt, coalesce(shard, term) AS shard, shard IS NULL AS alone FROM cnt LEFT JOIN fit USING (term))"""
_FILES = _SHARDS + """, gs AS (SELECT shard, alone, min(term) AS lo, CAST(sum(cnt) AS BIGINT) AS size, row_number() OVER (ORDER BY min(term)) AS i FROM sh GROUP BY 1, 2),
pk AS (SELECT i, CAST(0 AS BIGINT) AS file, size AS filled FROM gs WHERE i = 1 UNION ALL SELECT g.i, CASE WHEN pk.filled + g.size > 2000 THEN pk.file + 1 ELSE pk.file END, CASE WHEN pk.filled + g.size > 2000 THEN g.size ELSE pk.filled + g.size END FROM pk JOIN gs g ON g.i = pk.i + 1),
fl AS (SELECT shard, alone, lo, CAST(file AS INTEGER) AS file FROM gs JOIN pk USING (i)),
entries AS (SELECT DISTINCT file, lei FROM post JOIN sh USING (term) JOIN fl USING (shard, alone)),
rk AS (SELECT file, lei, count(*) OVER (PARTITION BY file) > 500 AS capped, row_number() OVER (PARTITION BY file ORDER BY round(p_retailprice / 1000, 1) DESC, lei) AS rank FROM entries JOIN part ON p_partkey = lei),
capd AS (SELECT file, lei, CAST(rank AS INTEGER) AS rank, capped FROM rk WHERE rank <= 500),
bd AS (SELECT file, min(lo) AS lo FROM fl GROUP BY 1), tb AS (SELECT file, lo, lead(lo) OVER (ORDER BY file) AS hi, coalesce((SELECT bool_or(capped) FROM capd WHERE capd.file = bd.file), false) AS capped FROM bd)"""


def _postings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = F.split(F.concat_ws(" ", "p_name", F.lower(F.translate("p_brand", "#", " ")), F.lower("p_type")), " ")
    return p.select(F.col("p_partkey").alias("lei"), F.explode(F.array_distinct(words)).alias("term")).where(F.length("term") >= 2)


def _packed(spark, sf_dir):
    post = _postings(spark, sf_dir)
    shards = staged(X.plan_shards(X.term_counts(post), 200), "shards")
    return post, shards, staged(X.pack_files(shards, 2000), "files")


def _capped(spark, sf_dir):
    post, shards, files = _packed(spark, sf_dir)
    entries = staged(X.files_of(post, shards, files), "entries")
    return staged(X.cap_files(entries, tables.prominences(spark, sf_dir), 500), "capped"), files


def _bounds(spark, sf_dir):
    """The routing table and the index that it routes into, each built once and read by what routes."""
    capped, files = _capped(spark, sf_dir)
    return staged(X.bounds(files, capped), "bounds"), capped


def _routing(spark, sf_dir):
    """The routing table alone: files are counted, and the index that it routes into is not built."""
    post, shards, files = _packed(spark, sf_dir)
    return staged(X.bounds(files, X.full_files(X.files_of(post, shards, files), 500)), "bounds")


@query(f"WITH {_POSTINGS} SELECT term, cnt FROM cnt")
def index_terms_postings(spark, sf_dir):
    return X.term_counts(_postings(spark, sf_dir))


@query(f"WITH {_SHARDS} SELECT term, cnt, shard, alone FROM sh")
def shard_plan(spark, sf_dir):
    return X.plan_shards(X.term_counts(_postings(spark, sf_dir)), 200)


@query(f"WITH RECURSIVE {_FILES} SELECT shard, alone, file, lo FROM fl")
def file_pack(spark, sf_dir):
    return _packed(spark, sf_dir)[2]


@query(f"WITH RECURSIVE {_FILES} SELECT file, lei, rank, capped FROM capd")
def cap_per_file(spark, sf_dir):
    return _capped(spark, sf_dir)[0]


@query(f"WITH RECURSIVE {_FILES} SELECT count(DISTINCT lei) AS reachable FROM capd")
def reachable(spark, sf_dir):
    return _capped(spark, sf_dir)[0].agg(F.count_distinct("lei").alias("reachable"))


@query(f"WITH RECURSIVE {_FILES} SELECT file, lo, hi, capped FROM tb")
def routing_table(spark, sf_dir):
    return _bounds(spark, sf_dir)[0]


@query(f"WITH RECURSIVE {_FILES}, ws AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents) SELECT word, coalesce(file, 0) AS file FROM ws ASOF LEFT JOIN tb ON ws.word >= tb.lo")
def file_of_word(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return X.file_of(w, _bounds(spark, sf_dir)[0], F.col("word"), "file")


def _route_sql(paused: bool, s: str = "") -> str:
    return f"""
cw{s} AS (SELECT qid, p - 1 AS pos, tokens[p] AS word, in_progress AND p = len(tokens) AS open FROM (SELECT qid, tokens, in_progress, unnest(range(1, len(tokens) + 1)) AS p FROM typed) WHERE length(tokens[p]) >= 3 AND tokens[p] NOT IN ({_STOP})),
px{s} AS (SELECT *, left(word, l) AS prefix FROM (SELECT *, unnest(range(3, length(word) + 1)) AS l FROM cw{s})),
pf{s} AS (SELECT x.*, coalesce(tb.file, 0) AS first FROM px{s} x ASOF LEFT JOIN tb ON x.prefix >= tb.lo),
pl{s} AS (SELECT x.*, coalesce(tb.file, 0) AS last FROM (SELECT *, prefix || chr(65535) AS far FROM pf{s}) x ASOF LEFT JOIN tb ON x.far >= tb.lo),
aw{s} AS (SELECT qid, pos, word, open, arg_min(first, l) FILTER (last = first) AS narrow, arg_max(first, l) AS own FROM pl{s} GROUP BY ALL),
af{s} AS (SELECT *, coalesce(narrow, CASE WHEN {paused} OR NOT open THEN own END) AS file FROM aw{s}),
an{s} AS (SELECT qid, file, row_number() OVER (PARTITION BY qid ORDER BY NOT coalesce(capped, false) AND (narrow IS NOT NULL OR NOT open) DESC, length(word) DESC, pos) AS nth FROM af{s} LEFT JOIN (SELECT file, capped FROM tb) USING (file) WHERE file IS NOT NULL),
ls{s} AS (SELECT qid, string_agg(CAST(file AS VARCHAR), ',' ORDER BY nth) AS files FROM (SELECT qid, file, min(nth) AS nth FROM an{s} WHERE nth <= 2 GROUP BY 1, 2) GROUP BY 1),
lw{s} AS (SELECT qid, tokens[1] AS word, len(tokens) = 1 AND length(tokens[1]) >= 2 AND {paused} AS lone FROM typed),
lf{s} AS (SELECT x.qid, CASE WHEN lone THEN CAST(coalesce(tb.file, 0) AS VARCHAR) ELSE '' END AS lone FROM lw{s} x ASOF LEFT JOIN tb ON x.word >= tb.lo),
routed{s} AS (SELECT qid, coalesce(files, lone) AS files FROM lf{s} LEFT JOIN ls{s} USING (qid))"""


def _alike(spark, sf_dir):
    """(typed, firsts): what is typed with `first`, the least query that is typed alike, and those queries alone. Queries typed alike route,
    match and rank alike, so that each text is searched once however often it is typed."""
    same = Window.partitionBy("tokens", "in_progress")
    typed = staged(_typed(spark, sf_dir).select("qid", "tokens", "in_progress", F.min("qid").over(same).alias("first")), "typed")
    return typed, staged(typed.where("qid = first").drop("first"), "firsts")


def _of_first(rows: DataFrame, typed: DataFrame) -> DataFrame:
    """rows (qid, ...) with the first query that is typed alike; null where nothing is typed."""
    return shuffled(rows).join(typed.select("qid", "first"), "qid", "left")


def _routed(spark, sf_dir, paused: bool):
    return X.route(staged(_typed(spark, sf_dir), "typed"), _routing(spark, sf_dir), paused=paused)


@query("WITH RECURSIVE " + _FILES + "," + _TYPED_SQL + "," + _route_sql(True) + " SELECT qid, files FROM routed")
def route_paused(spark, sf_dir):
    return _routed(spark, sf_dir, True).select("qid", F.array_join("files", ",").alias("files"))


@query("WITH RECURSIVE " + _FILES + "," + _TYPED_SQL + "," + _route_sql(False) + " SELECT qid, files FROM routed")
def route_typing(spark, sf_dir):
    return _routed(spark, sf_dir, False).select("qid", F.array_join("files", ",").alias("files"))


_POOL_SQL = "pool AS (SELECT DISTINCT qid, lei FROM (SELECT qid, CAST(unnest(string_split(files, ',')) AS INTEGER) AS file FROM routed WHERE files <> '') JOIN capd USING (file))"


@query("WITH RECURSIVE " + _FILES + "," + _TYPED_SQL + "," + _route_sql(True) + f", {_POOL_SQL}, rs AS (SELECT qid, lei, match + prominence AS score, row_number() OVER (PARTITION BY qid ORDER BY match + prominence DESC, lei) AS rank FROM scored JOIN pool USING (qid, lei)) SELECT qid, lei, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rs WHERE rank <= 10")
def routed_search(spark, sf_dir):
    """The index is written by file; only the files that a query routes to are read, by partition pruning."""
    bounds, capped = _bounds(spark, sf_dir)
    typed, firsts = _alike(spark, sf_dir)
    routed = X.route(firsts, bounds)
    path = written(capped.select("lei", "file"), "index", "file")
    pool = staged(X.candidates(routed, spark.read.parquet(path)), "pool")
    names = staged(tables.parts(spark, sf_dir), "names")
    hits = staged(M.top_k(firsts, names, names, 10, pool=pool), "hits")
    return shuffled(typed.select("qid", "first")).join(hits.withColumnRenamed("qid", "first"), "first").select("qid", "lei", "score", "rank")


@query("SELECT o_custkey, o_orderkey, (SELECT max_by(e.event_type, (e.ts, e.event_id)) FROM events e WHERE e.user_id = o_custkey AND e.ts <= o_orderdate) AS event_type FROM orders")
def asof_mapping(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey"), "ts", F.struct("event_id", "event_type").alias("found"))
    return E.latest_before(o, e, "o_custkey", "o_orderdate", "ts", "found").select("o_custkey", "o_orderkey", F.col("found.event_type").alias("event_type"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def code_lookup(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT p_size, p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_size ORDER BY sha1('seed:' || p_partkey), p_partkey) <= count(*) OVER (PARTITION BY p_size) // 2 THEN 'train' ELSE 'test' END AS split FROM part")
def split_5050(spark, sf_dir):
    return V.half_split(table(spark, sf_dir, "part").select("p_size", "p_partkey"), "p_partkey", "seed", "p_size")


@query("SELECT c_custkey, CAST(('0x' || right(sha1(CAST(c_custkey AS VARCHAR)), 1)) AS INTEGER) % 2 AS fold FROM customer")
def cv_fold(spark, sf_dir):
    h = F.right(F.sha1(F.col("c_custkey").cast("string").cast("binary")), F.lit(1))
    return table(spark, sf_dir, "customer").select("c_custkey", (F.conv(h, 16, 10).cast("int") % 2).alias("fold"))


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, max(o_totalprice) AS most FROM orders GROUP BY 1")
def percentile_summary(spark, sf_dir):
    return V.summary(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")


@query("SELECT user_id, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR nxt > ts + INTERVAL 30 MINUTE")
def debounce_pauses(spark, sf_dir):
    return S.pauses(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "30 minutes").select("user_id", "event_id")


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_seq(spark, sf_dir):
    return S.newest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type")


@query("SELECT DISTINCT user_id, event_type FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE value > 90 OR nxt IS NULL OR nxt >= ts + INTERVAL 2 HOUR")
def settled_searches(spark, sf_dir):
    return S.settled(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type", "2 hours", F.col("value") > 90)


@query("SELECT event_id, coalesce(ts < max(CASE WHEN value > 80 THEN ts + INTERVAL 1 HOUR END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS held FROM events")
def rate_hold(spark, sf_dir):
    return S.held(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("value") > 80, "1 hour").select("event_id", "held")


@query("SELECT p_partkey, k, left(p_name, k) AS typed FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS k FROM part)")
def keystroke_sessions(spark, sf_dir):
    return V.keystrokes(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "k", "typed")


@query("SELECT a.p_partkey, CASE WHEN b.p IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM part a LEFT JOIN (SELECT p_partkey AS p, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS s FROM part WHERE p_partkey % 9 <> 0) b ON a.p_partkey = b.p WHERE b.p IS NULL OR b.s <> a.p_size")
def index_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    other = p.where("p_partkey % 9 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return P.diff(p, other, ["p_partkey"], "p_size")


@query("SELECT p_size AS file, count(*) AS n, sha256(string_agg(p_partkey || ':' || p_name, chr(10) ORDER BY p_partkey)) AS sha256 FROM part GROUP BY 1")
def content_hash(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumnRenamed("p_size", "file")
    return P.content_hash(p, "file", ["p_partkey"], F.concat(F.col("p_partkey").cast("string"), F.lit(":"), F.col("p_name")))


_METRICS = (("entities", 3300000, 3310000, 3000000, 3700000, 3), ("files", 6438, 5000, 5500, 7500, 5), ("gzip", 220, 221, 190, 250, 10), ("reach", 95, 97, 96, 100, 1))


@query(f"SELECT name, CAST(value AS BIGINT) AS value, value BETWEEN lo AND hi AND abs(value - live) <= tol / 100.0 * live AS ok FROM (VALUES {_values(_METRICS)}) v(name, value, live, lo, hi, tol)")
def publish_checks(spark, sf_dir):
    m = spark.createDataFrame(_METRICS, "name string, value long, live long, lo long, hi long, tol int").withColumn("tolerance", F.col("tol") / 100)
    return P.bounded_checks(m)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def rollback_target(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    live = o.where("o_orderstatus = 'F'").agg(F.max("o_orderdate")).first()[0]
    builds = o.select(F.col("o_orderdate").alias("build"), F.col("o_orderkey").alias("created"))
    return P.rollback_target(builds, live).select(F.col("created").alias("o_orderkey"), F.col("build").alias("o_orderdate"))


@query("SELECT n_regionkey, n_name FROM (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) WHERE k = 1")
def first_named_code(spark, sf_dir):
    return E.first_named(table(spark, sf_dir, "nation"), "n_regionkey", ["n_name"], "n_nationkey").withColumnRenamed("name", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_custkey IN (SELECT o_custkey FROM orders) AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def anti_torso(spark, sf_dir):
    c, o, s = (table(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    pool = c.where("c_acctbal >= 0").join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return pool.join(s.where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey", "left_anti").select("c_custkey")


@query("SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY lower(text)) AS n FROM documents) WHERE n = 1")
def unique_names_tail(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("norm", F.sha2(F.lower("text"), 256))
    once = d.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    return once.select("doc_id")


@query("SELECT DISTINCT a, b FROM (SELECT o_orderkey AS a, o_custkey AS b FROM orders UNION ALL SELECT o_custkey, o_orderkey FROM orders)")
def lenient_targets(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))
    return E.neighbours(edges, "a", "b")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def record_flatten(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT '{' || string_agg('\"' || n_nationkey || '\":\"' || n_name || '\"', ',' ORDER BY CAST(n_nationkey AS VARCHAR)) || '}' AS json FROM nation")
def codes_json(spark, sf_dir):
    pairs = F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.col("n_name"))))
    return table(spark, sf_dir, "nation").agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def _by_text(spark, sf_dir):
    """The queries' texts (qid, text), and features of each text (as qid) with the entities that have one name and one prominence (lei: the
    least of them). Of these the least comes first whatever a score makes of both."""
    typed, names = staged(_typed(spark, sf_dir), "typed"), staged(tables.parts(spark, sf_dir), "names")
    alike = M.owners(names).groupBy("shape", "prominence").agg(F.min("lei").alias("lei"))
    found = staged(M.text_features(typed, names), "features").join(alike, "shape").withColumnRenamed("text", "qid")
    return typed.select("qid", M.query_text().alias("text")), found


@query("WITH " + _TYPED_SQL + """, g2 AS (SELECT CAST(wm AS DOUBLE) AS wm, CAST(wf AS DOUBLE) AS wf FROM (SELECT unnest([2.0, 4.83]) AS wm), (SELECT unnest([0.5, 1.19]) AS wf)),
sg AS (SELECT wm, wf, qid, lei, (CASE WHEN n_miss = 0 THEN 2.59e0 ELSE 0e0 END) + 2.96e0 * n_exact / n + (CASE WHEN exact THEN 0.55e0 ELSE 0e0 END) + (CASE WHEN prefix THEN 0.84e0 ELSE 0e0 END) + 2.26e0 * coverage - wm * n_miss - wf * n_fuzzy + prominence AS score FROM f, g2 WHERE shown)
SELECT wm, wf, qid, lei FROM (SELECT *, row_number() OVER (PARTITION BY wm, wf, qid ORDER BY score DESC, lei) AS k FROM sg) WHERE k = 1""")
def weight_grid(spark, sf_dir):
    texts, found = _by_text(spark, sf_dir)
    grid = [(m, f) for m in (2.0, 4.83) for f in (0.5, 1.19)]
    best = V.best_of_grid(found.where("shown"), grid, M.match_score(M.MATCH | {"miss": 0.0, "fuzzy": 0.0}))
    return best.withColumnRenamed("qid", "text").join(texts, "text").select("wm", "wf", "qid", "lei")
