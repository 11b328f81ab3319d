"""Domain tables as projections of the driver's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    first = o.groupBy(F.col("o_custkey").alias("lei")).agg(F.min("o_orderdate").alias("d"))
    status = F.element_at(F.array(*map(F.lit, ("ISSUED", "LAPSED", "PENDING_TRANSFER", "PENDING_ARCHIVAL", "RETIRED", "DUPLICATE", "ANNULLED", "MERGED"))), (F.col("c_custkey") % 8).cast("int") + 1)
    out = c.select(
        F.col("c_custkey").alias("lei"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") < 0, "INACTIVE").otherwise("ACTIVE").alias("entity_status"),
        status.alias("registration"), F.when(F.col("c_mktsegment") == "FURNITURE", "FUND").otherwise("GENERAL").alias("category"), "c_nationkey",
    ).join(first, "lei", "left")
    return out.withColumn("registered_year", F.year("d") + (F.month("d") - 1) / 12).drop("d")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.substring("o_orderpriority", 1, 1)
    named = F.when(kind == "1", "IS_DIRECTLY_CONSOLIDATED_BY").when(kind == "2", "IS_ULTIMATELY_CONSOLIDATED_BY").when(kind == "3", "IS_INTERNATIONAL_BRANCH_OF").otherwise("IS_SUBFUND_OF")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("child"), F.col("o_custkey").alias("parent"), named.alias("type"), F.when(F.col("o_orderstatus") == "P", "INACTIVE").otherwise("ACTIVE").alias("status"))


def isins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(o, lines["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("lei"))


def bics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.join(s.select(F.col("s_nationkey").alias("c_nationkey")).distinct(), "c_nationkey", "left_semi").select(F.col("c_custkey").alias("lei"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the search queries: part names with prominence in tenths."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("lei"), F.lit(0).alias("name_no"), F.col("p_name").alias("name"), T.name_seq(F.col("p_name")).alias("seq"), T.name_extras(F.col("p_name")).alias("extras"), F.round(F.col("p_retailprice") / 1000, 1).alias("prominence"))


def prominences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lei, prominence) of parts(), without the fold of names, whose tables fill the driver with every plan that holds them."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lei"), F.round(F.col("p_retailprice") / 1000, 1).alias("prominence"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, lei) of documents' words, as an index has them."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("lei"), T.name_seq(F.col("text")).alias("seq"))
    return d.select("lei", F.explode(F.filter(F.array_distinct("seq"), lambda x: F.length(x) >= 2)).alias("term"))
