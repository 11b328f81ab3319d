"""Checks before a build is published, comparison of builds, and the build to roll back to."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_checks(metrics: DataFrame) -> DataFrame:
    """(name, value, ok) of metrics (name, value, live, lo, hi, tolerance): inside its range and within tolerance of the live value."""
    near = F.col("live").isNull() | (F.abs(F.col("value") - F.col("live")) <= F.col("tolerance") * F.col("live"))
    return metrics.select("name", "value", (F.col("value").between(F.col("lo"), F.col("hi")) & near).alias("ok"))


def rollback_target(builds: DataFrame, live: str) -> DataFrame:
    """The newest build before the live one; of equals the one made last."""
    return builds.where(F.col("build") < live).orderBy(F.col("build").desc(), F.col("created").desc()).limit(1)


def diff(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, kind): rows only in a, only in b, or with another value."""
    x, y = a.select(*keys, F.col(value).alias("a_")), b.select(*keys, F.col(value).alias("b_"))
    both = x.withColumn("in_a", F.lit(True)).join(y.withColumn("in_b", F.lit(True)), keys, "full_outer")
    kind = F.when(F.col("in_b").isNull(), "removed").when(F.col("in_a").isNull(), "added").when(~F.col("a_").eqNullSafe(F.col("b_")), "changed")
    return both.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(*keys, "kind")


def content_hash(rows: DataFrame, by: str, order: list[str], line) -> DataFrame:
    """(by, n, sha256) of each file's lines in order."""
    listed = F.sort_array(F.collect_list(F.struct(*order, line.alias("line_"))))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(listed, lambda x: x["line_"]), "\n"), 256).alias("sha256"))


def blocking_checks(metrics: DataFrame, build: dict, queries: DataFrame, config: dict, live: dict | None = None, accept_change: bool = False) -> DataFrame:
    """(name, value, ok) of all checks of a build. metrics as for bounded_checks (relative bounds are left out if the change is
    accepted); build has missing, entities, records and objective; queries (query, expected, first); live may have objective."""
    spark = metrics.sparkSession
    bounds = bounded_checks(metrics.withColumn("live", F.lit(None).cast("double")) if accept_change else metrics).select("name", F.col("value").cast("string").alias("value"), "ok")
    reach = build["entities"] / build["records"] if build["records"] else 0.0
    objective, before = build.get("objective"), (live or {}).get("objective")
    good = objective is not None and objective >= config["objective"] and (before is None or accept_change or objective >= before - config["objective_drop"])
    single = [("files on disk", f"{len(build['missing'])} missing", not build["missing"]), ("reachability", f"{reach:.4f}", reach >= config["reachability"]), ("objective", "not measured" if objective is None else f"{objective:.4f}", good)]
    fixed = queries.select(F.concat(F.lit("query "), "query").alias("name"), F.coalesce("first", F.lit("no result")).alias("value"), F.coalesce(F.col("first") == F.col("expected"), F.lit(False)).alias("ok"))
    return bounds.unionByName(spark.createDataFrame(single, "name string, value string, ok boolean")).unionByName(fixed)


def check_table(checks: DataFrame) -> DataFrame:
    """(table): checks (name, value, ok) as one Markdown table, failed ones first, then by name. A build has some dozens of checks."""
    told = F.when(F.col("ok"), "ok").otherwise("FAILED")
    cell = lambda c: F.regexp_replace(F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\r\n", "  "), r"\|", r"\\|")
    rows = F.sort_array(F.collect_list(F.struct("ok", "name", F.concat(F.lit("| "), cell("name"), F.lit(" | "), cell("value"), F.lit(" | "), told, F.lit(" |")).alias("line"))))
    head = F.array(F.lit("| check | value | result |"), F.lit("| - | - | - |"))
    return checks.agg(F.array_join(F.concat(head, F.transform(rows, lambda r: r["line"])), "\n").alias("table"))
