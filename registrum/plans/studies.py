"""Queries of studies: ranks of targets, keystrokes, precision, sizes and churn, and the SQL that each must equal."""

from pyspark.sql import functions as F

from registrum.functions import numeric as N
from registrum.operators import evaluate as V
from registrum.operators import index as X
from registrum.operators import match as M
from registrum.plans import tables
from registrum.plans.catalogue import _TARGETS, _TYPED_SQL, _by_text, _targets, _typed
from registrum.plans.registry import query
from registrum.plans.tables import table
from registrum.session import staged
from registrum.streaming import sessions


@query("SELECT c_custkey, CAST(('0x' || left(sha256(CAST(c_custkey AS VARCHAR)), 8)) AS BIGINT) % 600 / 100 - 3 AS prominence FROM customer")
def stand_in_prominence(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", N.stand_in_prominence(F.col("c_custkey")).alias("prominence"))


@query("WITH " + _TYPED_SQL + f", {_TARGETS} SELECT qid, lei, rank FROM targets LEFT JOIN hits USING (qid, lei)")
def target_rank(spark, sf_dir):
    typed, names = staged(_typed(spark, sf_dir), "typed"), staged(tables.parts(spark, sf_dir), "names")
    owners = staged(M.owners(names), "owners")
    found = M.text_features(typed, names).withColumn("match", M.match_score()).where("match IS NOT NULL")
    scored = found.join(owners.select("shape", "prominence").distinct(), "shape").select("text", "shape", "prominence", (F.col("match") + F.col("prominence")).alias("score"))
    targets = _targets(spark, sf_dir).select("qid", "lei").join(typed.select("qid", M.query_text().alias("text")), "qid", "left")
    return V.rank_of_owner(staged(scored, "scored"), owners, targets)


_STROKES = "WITH n AS (SELECT o_custkey AS qid, min(CASE WHEN r <= 5 THEN k END) AS top5, min(CASE WHEN r <= 1 THEN k END) AS top1, min(CASE WHEN r <= 5 THEN k END) / max(k) AS share FROM (SELECT o_custkey, o_orderkey % 50 + 1 AS k, o_orderkey % 23 + 1 AS r FROM orders) GROUP BY 1) "


def _strokes(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), (k % 50 + 1).alias("k"), (k % 50 + 1).alias("length"), (k % 23 + 1).alias("rank"))
    return V.keystrokes_needed(o)


@query(_STROKES + "SELECT qid, top5, top1, round(share, 9) AS share FROM n")
def first_keystrokes(spark, sf_dir):
    return _strokes(spark, sf_dir).withColumn("share", F.round("share", 9))


@query(_STROKES + "SELECT count(*) AS n, round(avg(CASE WHEN top5 IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS reached, round(quantile_cont(top5, 0.5), 6) AS median_k, round(quantile_cont(share, 0.5), 6) AS median_share FROM n")
def keystroke_summary(spark, sf_dir):
    return V.keystroke_summary(_strokes(spark, sf_dir))


@query("WITH " + _TYPED_SQL + ", e AS (SELECT p.name AS precision, qid, lei, match + CASE WHEN p.step = 0 THEN prominence ELSE floor(prominence / p.step + 0.5e0) * p.step END AS s FROM scored, (VALUES ('full', 0.0::DOUBLE), ('half', 0.5::DOUBLE), ('one', 1.0::DOUBLE)) p(name, step)) SELECT precision, qid, arg_min(lei, (-s, lei)) AS lei FROM e GROUP BY 1, 2")
def precision_study(spark, sf_dir):
    texts, found = _by_text(spark, sf_dir)
    best = V.first_by_precision(found.withColumn("match", M.match_score()).where("match IS NOT NULL"), {"full": 0.0, "half": 0.5, "one": 1.0})
    return best.withColumnRenamed("qid", "text").join(texts, "text").select("precision", "qid", "lei")


def _lines(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_size").alias("file"), F.col("p_partkey").alias("rank"), F.col("p_name").alias("line"))


@query("SELECT p_size AS file, count(*) AS n, CAST(sum(strlen(p_name) + 1) AS BIGINT) AS bytes, true AS packed FROM part GROUP BY 1")
def index_file_sizes(spark, sf_dir):
    """The compressed sizes are held against the compressor's own in the tests."""
    return X.index_sizes(_lines(spark, sf_dir)).select("file", "n", "bytes", (F.col("gzip") > 20).alias("packed"))


@query("SELECT count(*) AS files, count(*) FILTER (c) AS changed, round(avg(CASE WHEN c THEN 1.0 ELSE 0.0 END), 9) AS share FROM (SELECT p_size, bool_or(p_partkey % 40 = 0) AS c FROM part GROUP BY 1)")
def index_churn(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return X.churn(lines, lines.withColumn("line", F.when(F.col("rank") % 40 == 0, F.concat("line", F.lit("!"))).otherwise(F.col("line"))))


@query("SELECT event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR nxt > ts + CASE WHEN event_type = 'click' THEN INTERVAL 3 HOUR ELSE INTERVAL 1 HOUR END")
def debounce_by_kind(spark, sf_dir):
    return sessions.pauses_by_kind(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type", {"click": "3 hours"}, "1 hour").select("event_id")
