"""Running counts that survive a hot key.

A plain window puts all rows of a key into one task. Here a key's rows are dealt into blocks that
follow its order (a day, a range of positions, the first letters of a name): each block's counts are
summed with a partial aggregate, the blocks before give a block its offset, and windows run within
(key, block) only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Whole numbers that one block spans.
SPAN = 1 << 16


def block_of(number: str) -> Column:
    """Blocks of a column of whole numbers."""
    return F.floor(F.col(number) / SPAN)


def running_counts(rows: DataFrame, key: str, block: Column, order: list[str], counts: dict[str, Column]) -> DataFrame:
    """rows with a column for each of counts: how many rows of the key, up to and with this one in the
    given order, meet the condition. See running_sums."""
    return running_sums(rows, key, block, order, {n: F.when(c, 1).otherwise(0) for n, c in counts.items()})


def running_sums(rows: DataFrame, key: str, block: Column, order: list[str], numbers: dict[str, Column]) -> DataFrame:
    """rows with a column for each of numbers: its sum over the rows of the key, up to and with this one in the
    given order. block must not fall where order rises. Rows without a key count as one key; ties in order
    are broken arbitrarily. An empty table gives an empty table."""
    ones = {n: c.cast("long") for n, c in numbers.items()}
    blocked = rows.withColumn("_block", block)
    sums = blocked.groupBy(F.col(key).alias("_key"), "_block").agg(*(F.sum(c).alias(f"_{n}") for n, c in ones.items()))
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_key", F.col("_block").alias("_at"), *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in numbers))
    joined = blocked.join(offsets, blocked[key].eqNullSafe(F.col("_key")) & blocked["_block"].eqNullSafe(F.col("_at")))
    within = Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*(rows[c] for c in rows.columns), *((F.sum(ones[n]).over(within) + F.col(f"_{n}")).alias(n) for n in numbers))
