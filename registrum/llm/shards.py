"""Contiguous shards of near-equal bytes: prefix sums over per-partition totals, cut at equal targets."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registrum.llm._shared import scratch, staged, unused


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and one for its end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_contiguous(rows: DataFrame, n_shards: int, *, size: str = "size", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The rows with shard (0 to n_shards - 1) and slot (gapless from 0 in its shard), shards contiguous in the order given
    (nulls first; ties fall as they are read) and cut where the running sum of sizes passes equal shares of the total.

    Rows are dealt out by ranges of the order, with ties broken by a row number, so that equal keys share no one task; each
    range gives one total; only those totals are summed in one task. Repeated rows each keep a place. No rows, no shards.
    """
    tie = F.monotonically_increasing_id()
    laid = rows.withColumn("tie_", tie).repartitionByRange(*order, "tie_").withColumn("part_", F.spark_partition_id())
    laid = staged(laid, "ranges")  # the ranges are sampled: written once, they stay as they are
    totals = laid.groupBy("part_").agg(F.sum(size).alias("bytes_"), F.count(F.lit(1)).alias("rows_"))
    every = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part_", F.coalesce(F.sum("bytes_").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes_").over(every).alias("all_"))
    here = Window.partitionBy("part_").orderBy(*(F.col(c).asc_nulls_first() for c in order), "tie_")
    summed = (
        laid.withColumn("bytes_here", F.sum(size).over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size))
        .withColumn("rows_here", F.row_number().over(here) - 1)
        .join(F.broadcast(offsets), "part_")  # a row for each range
        .withColumn("start_", F.col("bytes_before") + F.col("bytes_here"))
        .withColumn("nth_", F.col("rows_before") + F.col("rows_here"))
        .withColumn("shard", F.expr(f"least({n_shards - 1}, cast((start_ * {n_shards}) div all_ as int))"))
    )
    summed = staged(summed.select(*rows.columns, "nth_", "shard"), "placed")
    first = summed.groupBy("shard").agg(F.min("nth_").alias("first_"))
    return summed.join(F.broadcast(first), "shard").select(*rows.columns, "shard", (F.col("nth_") - F.col("first_")).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 16, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every document; a null text has size 1 and the CRC of no bytes."""
    rows = docs.select(docs[key].alias(key), text_size(docs[text]).alias("size"), F.crc32(F.coalesce(docs[text], F.lit("")).cast("binary")).alias("text_crc32"))
    return shard_contiguous(rows, n_shards, order=(key,))


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, *, key: str = "doc_id", text: str = "text", slots: int = 100_000) -> DataFrame:
    """The documents themselves, written under path in a folder for each shard and a file for each `slots` slots; returns the plan
    (key, size, shard, slot). Every row is written once with all its columns, null and repeated keys among them; a column of docs named
    shard keeps its name, and the folders' column takes another."""
    row, shard, slot = (unused(docs, c) for c in ("row", "shard", "slot"))
    with scratch(docs.sparkSession) as keep:
        held = staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        plan = shard_contiguous(held.select(key, F.col(row).alias("row_"), text_size(F.col(text)).alias("size")), n_shards, order=(key, "row_"))
        plan = keep(staged(plan, "plan"))
        placed = held.join(plan.select(F.col("row_").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot)), row)
        placed.repartition(shard, (F.col(slot) / slots).cast("int")).drop(row, slot).write.partitionBy(shard).parquet(path)
    return plan.drop("row_")
