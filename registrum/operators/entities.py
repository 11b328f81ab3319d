"""Building entities: validation, status letters, signals and prominence, variants of names, code lists, lookups."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registrum.functions import numeric
from registrum.functions.constants import STATUS_LETTERS


def skip_reason() -> Column:
    """Why a row is skipped (the first reason wins), or null, over lei, country, registration and name."""
    return (
        F.when(~F.col("lei").rlike("^[0-9A-Z]{20}$"), "bad LEI")
        .when(~F.col("country").rlike("^[A-Z]{2}$"), "bad country")
        .when(~F.col("registration").isin(*STATUS_LETTERS), "unknown status")
        .when(F.trim("name") == "", "empty name")
    )


def skip_counts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reason", skip_reason()).where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def skip_examples(rows: DataFrame, row: str, most: int = 20) -> DataFrame:
    """(reason, row, lei): of each reason the first rows skipped, as a report shows them."""
    skipped = rows.withColumn("reason", skip_reason()).where(F.col("reason").isNotNull())
    nth = F.row_number().over(Window.partitionBy("reason").orderBy(row))
    return skipped.withColumn("nth_", nth).where(F.col("nth_") <= most).select("reason", row, "lei")


def check_skipped(rows: DataFrame, most: int = 1000, share: float = 0.001) -> DataFrame:
    """The rows that aren't skipped; fails if more than `most` of them or more than their share are."""
    skipped, n = rows.agg(F.count_if(skip_reason().isNotNull()), F.count(F.lit(1))).first()
    if skipped > most or skipped > share * n:
        raise ValueError(f"{skipped} of {n} rows would be skipped")
    return rows.where(skip_reason().isNull())


def status_letter(registration: Column, entity_status: Column) -> Column:
    letters = F.create_map(*(F.lit(x) for pair in STATUS_LETTERS.items() for x in pair))
    letter = F.element_at(letters, registration)
    return F.when(entity_status == "INACTIVE", F.lower(letter)).otherwise(letter)


def parent_counts(relations: DataFrame) -> DataFrame:
    """(parent, n_direct, n_ultimate, n_branch) of active relations (child, parent, type, status). The filter reaches the scan."""
    kinds = {"n_direct": "IS_DIRECTLY_CONSOLIDATED_BY", "n_ultimate": "IS_ULTIMATELY_CONSOLIDATED_BY", "n_branch": "IS_INTERNATIONAL_BRANCH_OF"}
    active = relations.where((F.col("status") == "ACTIVE") & F.col("type").isin(*kinds.values()))
    return active.groupBy("parent").agg(*(F.count_if(F.col("type") == t).alias(n) for n, t in kinds.items()))


def has_parent(relations: DataFrame) -> DataFrame:
    """(child): those consolidated directly or ultimately; branches don't count."""
    kinds = ("IS_DIRECTLY_CONSOLIDATED_BY", "IS_ULTIMATELY_CONSOLIDATED_BY")
    return relations.where((F.col("status") == "ACTIVE") & F.col("type").isin(*kinds)).select("child").distinct()


def key_counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def with_signals(entities: DataFrame, relations: DataFrame, isins: DataFrame, bics: DataFrame, now_year: float) -> DataFrame:
    """Entities (lei, ...) with their counts and prominence; what is missing counts 0."""
    counts, kids = parent_counts(relations).withColumnRenamed("parent", "lei"), has_parent(relations).select(F.col("child").alias("lei"), F.lit(True).alias("has_parent"))
    isin = key_counts(isins, "lei").withColumnRenamed("n", "isin")
    bic = bics.select("lei").distinct().withColumn("bic", F.lit(True))
    out = entities.join(counts, "lei", "left").join(kids, "lei", "left").join(isin, "lei", "left").join(bic, "lei", "left")
    out = out.na.fill(0, ["n_direct", "n_ultimate", "n_branch", "isin"]).na.fill(False, ["has_parent", "bic"])
    return out.withColumn("name_length", F.char_length("name")).withColumn("prominence", numeric.prominence(now_year))


def first_variants(variants: DataFrame, entity: str, shape: str, order: list[str]) -> DataFrame:
    """The first of an entity's variants of one shape, in the order given."""
    nth = F.row_number().over(Window.partitionBy(entity, shape).orderBy(*order))
    return variants.withColumn("nth_", nth).where("nth_ = 1").drop("nth_")


def listed_names(names: Column, legal: Column) -> Column:
    return F.array_except(F.array_distinct(names), F.array(legal))


def first_named(codes: DataFrame, code: str, columns: list[str], row: str) -> DataFrame:
    """(code, name): of each code's rows the first with a name, the first of the columns that isn't empty."""
    name = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))
    return codes.withColumn("name_", name).where(F.col("name_").isNotNull()).groupBy(code).agg(F.min_by("name_", row).alias("name"))


def latest_before(left: DataFrame, right: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """left with the value of the newest right row of its key at or before its time: an as-of lookup. Both sides are merged by time in
    one window over the key, so that no pairs are made."""
    marked = left.select(key, F.col(at).alias("t_"), F.lit(1).alias("side_"), F.struct(*left.columns).alias("row_"), F.lit(None).cast(right.schema[value].dataType).alias("v_"))
    events = right.select(key, F.col(since).alias("t_"), F.lit(0).alias("side_"), F.lit(None).cast(marked.schema["row_"].dataType).alias("row_"), F.col(value).alias("v_"))
    w = Window.partitionBy(key).orderBy("t_", "side_", "v_").rowsBetween(Window.unboundedPreceding, 0)
    met = marked.unionByName(events).withColumn("found_", F.last("v_", ignorenulls=True).over(w)).where("side_ = 1")
    return met.select("row_.*", F.col("found_").alias(value))


def neighbours(edges: DataFrame, one: str, other: str) -> DataFrame:
    """Both directions of every edge, each once: what stands next to what."""
    return edges.select(one, other).unionByName(edges.select(F.col(other).alias(one), F.col(one).alias(other))).distinct()
