"""Fitting the weights of the ranking: a conditional logit over each query's candidates, its strength by cross-validation, and a search
along coordinates. Gradients and curvature are aggregates over the candidates; only a matrix of weights by weights reaches the driver."""

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registrum.operators.evaluate import hash_rank

MOST_STEPS = 50


def _score(names: list[str], w: np.ndarray) -> Column:
    return sum((F.col(n) * F.lit(float(x)) for n, x in zip(names, w, strict=True)), F.lit(0.0))


def _times(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(1)


def prepare(candidates: DataFrame, features: list[str]) -> DataFrame:
    """Candidates (qid, stratum, lei, target, features, score) as a design: one entity of each query is the target, the best-scoring
    (then least) of those marked; queries without one are left out; strata weigh alike whatever their size, with mean 1. A column n tells of how many entities with
    the same features a row (with the least lei) stands for, a column times for how many queries with the same candidates."""
    order = Window.partitionBy("qid").orderBy(F.col("target").desc(), F.col("score").desc(), "lei")
    chosen = candidates.withColumns({c: _times(candidates, c) for c in ("n", "times")}).withColumn("hit", (F.row_number().over(order) == 1) & F.col("target"))
    good = chosen.where("hit").select("qid", "stratum", "times")
    sizes = good.groupBy("stratum").agg(F.sum("times").alias("n_"))
    # queries of a stratum weigh queries / (strata * queries of the stratum)
    queries, strata = sizes.agg(F.coalesce(F.sum("n_"), F.lit(0)), F.count(F.lit(1))).first()
    weights = sizes.select("stratum", (F.lit(float(queries)) / (F.lit(float(max(strata, 1))) * F.col("n_"))).alias("weight"))
    return chosen.join(good.select("qid"), "qid", "left_semi").join(weights, "stratum").select("qid", "hit", "weight", "n", "times", *(F.col(f).cast("double").alias(f) for f in features))


def loss_terms(design: DataFrame, features: list[str], w: np.ndarray, strength: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian at w, from two aggregations: within queries (probabilities by a softmax that starts at the query's
    greatest score), then over queries."""
    k = len(features)
    scored = design.withColumn("s_", _score(features, w))
    top = F.max("s_").over(Window.partitionBy("qid"))
    scored = scored.withColumn("top_", top).withColumn("e_", F.exp(F.col("s_") - F.col("top_")) * _times(design, "n"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    x = [F.col(f) for f in features]
    by_query = scored.groupBy("qid").agg(
        F.first(F.col("weight") * _times(design, "times")).alias("g_"),
        F.first(_times(design, "times")).alias("times_"),
        F.sum("e_").alias("z_"),
        F.first("top_").alias("top_"),
        F.sum(F.when(F.col("hit"), F.col("s_"))).alias("hit_"),
        *(F.sum(F.col("e_") * x[i]).alias(f"m{i}") for i in range(k)),
        *(F.sum(F.when(F.col("hit"), x[i])).alias(f"t{i}") for i in range(k)),
        *(F.sum(F.col("e_") * x[i] * x[j]).alias(f"c{i}_{j}") for i, j in pairs),
    )
    mean = [F.col(f"m{i}") / F.col("z_") for i in range(k)]
    row = by_query.agg(
        F.sum("times_"),
        F.sum(F.col("g_") * (F.col("top_") + F.log("z_") - F.col("hit_"))),
        *(F.sum(F.col("g_") * (mean[i] - F.col(f"t{i}"))) for i in range(k)),
        *(F.sum(F.col("g_") * (F.col(f"c{i}_{j}") / F.col("z_") - mean[i] * mean[j])) for i, j in pairs),
    ).first()
    n = row[0]
    if not n:
        return 0.5 * strength * float(w @ w), strength * w, strength * np.eye(k)
    curve = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[2 + k :], strict=True):
        curve[i, j] = curve[j, i] = v / n
    return row[1] / n + 0.5 * strength * float(w @ w), np.array(row[2 : 2 + k]) / n + strength * w, curve + strength * np.eye(k)


def fit(design: DataFrame, features: list[str], strength: float, tolerance: float = 1e-8) -> tuple[dict[str, float], float]:
    """Weights and loss at the minimum, by Newton steps halved until the loss falls. The loss is convex: a handful of passes."""
    design = design.persist()
    try:
        w = np.zeros(len(features))
        loss, grad, curve = loss_terms(design, features, w, strength)
        for _ in range(MOST_STEPS):
            if np.abs(grad).max(initial=0.0) < tolerance:
                break
            step, size = np.linalg.lstsq(curve, grad, rcond=None)[0], 1.0
            while True:
                new = loss_terms(design, features, w - size * step, strength)
                if new[0] <= loss or size < 1e-6:
                    break
                size /= 2
            if size < 1e-6:
                break
            w, (loss, grad, curve) = w - size * step, new
        return dict(zip(features, map(float, w), strict=True)), loss
    finally:
        design.unpersist()


def fold_of(key: Column) -> Column:
    """0 or 1 by the last digit of a hash of the key."""
    return (F.conv(F.right(hash_rank(key, "cv"), F.lit(1)), 16, 10).cast("int") % 2).alias("fold")


def choose_strength(folded: DataFrame, features: list[str], strengths: list[float], measure: Callable[[dict[str, float], DataFrame], float]) -> tuple[float, dict[float, float]]:
    """The strength whose weights, fitted on one fold (a column 0 or 1 of candidates), measure best on the other, and every mean."""
    means = {}
    for s in strengths:
        means[s] = float(np.mean([measure(fit(prepare(folded.where(F.col("fold") != k), features), features, s)[0], folded.where(F.col("fold") == k)) for k in (0, 1)]))
    return max(means, key=means.get), means


def reciprocal_rank(weights: dict[str, float], candidates: DataFrame, k: int = 10) -> float:
    """Mean over strata of the mean reciprocal rank of each query's best target within the first k."""
    w = Window.partitionBy("qid").orderBy(_score(list(weights), np.array(list(weights.values()))).desc(), "lei")
    ranked = candidates.withColumn("r_", F.row_number().over(w))
    best = ranked.groupBy("stratum", "qid").agg(F.min(F.when(F.col("target"), F.col("r_"))).alias("r_"))
    by = best.groupBy("stratum").agg(F.avg(F.when(F.col("r_") <= k, 1 / F.col("r_")).otherwise(0.0)).alias("mrr"))
    return by.agg(F.avg("mrr")).first()[0] or 0.0


def search_coordinates(start: dict[str, float], steps: dict[str, float], measure: Callable[[dict[str, float]], float], passes: int = 3, least_gain: float = 1e-4, not_negative: tuple[str, ...] = ()) -> tuple[dict[str, float], float]:
    """Weights changed one at a time by one step or two either way as long as the measure gains; steps are halved after a pass without
    gain."""
    best, at, scale = measure(start), dict(start), 1.0
    for _ in range(passes):
        gained = False
        for name, step in steps.items():
            for move in (-1, 1, -2, 2):
                tried = at | {name: round(at[name] + move * step * scale, 4)}
                if name in not_negative and tried[name] < 0:
                    continue
                if (value := measure(tried)) > best + least_gain:
                    best, at, gained = value, tried, True
                    break
        scale = scale if gained else scale / 2
    return at, best


def ablations(candidates: DataFrame, weights: dict[str, float], groups: dict[str, list[str]]) -> DataFrame:
    """(variant, stratum, mrr): with all weights, and with those of each group at 0. Candidates are scored once for all variants. A column
    times tells for how many queries with the same candidates a row stands."""
    variants = {"all": []} | groups
    score = lambda off: _score(list(weights), np.array([0.0 if n in off else x for n, x in weights.items()]))
    out = candidates.select("qid", "stratum", "lei", "target", _times(candidates, "times").alias("times"), F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), score(off).alias("s")) for v, off in variants.items()))).alias("v"))
    ranked = out.withColumn("r_", F.row_number().over(Window.partitionBy("v.variant", "qid").orderBy(F.col("v.s").desc(), "lei")))
    best = ranked.groupBy(F.col("v.variant").alias("variant"), "stratum", "qid").agg(F.min(F.when(F.col("target"), F.col("r_"))).alias("r_"), F.first("times").alias("times"))
    gain = F.when(F.col("r_") <= 10, 1 / F.col("r_")).otherwise(0.0)
    return best.groupBy("variant", "stratum").agg(F.round(F.sum(gain * F.col("times")) / F.sum("times"), 9).alias("mrr"))
