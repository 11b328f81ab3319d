"""Connected components of a link table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registrum.llm._shared import scratch, staged


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """One star round over (u, v): joins each node's larger (or smaller) neighbours to the least of its neighbourhood."""
    if small:
        near = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component), staged: every node of the links (u, v) with the least node that it is joined to. Only links are shuffled;
    minima are pre-aggregated, and the links of a node with very many are split by the planner's skew join. Empty in, empty out."""
    with scratch(links.sparkSession) as keep:
        now = staged(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        state = _state(now)
        while True:
            now = staged(_stars(_stars(now, small=False), small=True), "links")
            before, state = state, _state(now)
            if state == before:
                break
        roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return keep(staged(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components"))
