"""How large tables are joined."""

from pyspark.sql import DataFrame


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that shuffles and sorts both sides. The planner broadcasts through the driver what it takes for small by the bytes of
    its files, but a million rows that are much alike pack into a few MB, and exploded ones into fewer than they then take."""
    return df.hint("merge")
