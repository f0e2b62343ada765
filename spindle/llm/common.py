"""Helpers shared by the operators: staging tables and reading Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, drop_at_exit, fresh_folder, ship, spread, stage  # noqa: F401

#: The letters that "lower-casing A-Z only" maps.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows that an operator's function gets at once; Spark bounds the bytes of a batch (64 MB by default).
BATCH_ROWS = 500


def _in_slices(function):
    """Of a batch of many rows one slice after the other, so that only its rows are Python objects."""

    def run(batches):
        return function(b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS))

    return run


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow, with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(_in_slices(function), schema)


#: Bits of a table of fixed size (2 MB) that says which keys may be among some others.
BITS = 24


def bit_parts(bits: DataFrame) -> DataFrame:
    """(bucket, part): the table of a column ``bit``; 512 rows of 4 KB at most, whatever the input."""
    return bits.groupBy(F.shiftright("bit", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("part"))


def perhaps_in(rows: DataFrame, keys: list[str], wanted: DataFrame, wanted_keys: list[str]) -> DataFrame:
    """rows without most of those whose keys are not in wanted. The table that is broadcast has a fixed
    size; it lets all rows of wanted pass, and the more others the more wanted there are."""
    bit = lambda cs: F.shiftrightunsigned(F.xxhash64(*cs), 64 - BITS)
    parts = bit_parts(wanted.select(bit(wanted_keys).alias("bit"))).select(F.col("bucket").alias("_bucket"), F.col("part").alias("_part"))
    placed = rows.withColumn("_bit", bit(keys))
    joined = placed.join(F.broadcast(parts), F.shiftright("_bit", 15) == F.col("_bucket"))
    byte = "CAST(conv(hex(substring(_part, CAST(shiftright(_bit, 3) & 4095 AS INT) + 1, 1)), 16, 10) AS INT)"
    return joined.where(f"shiftright({byte}, CAST(_bit & 7 AS INT)) & 1 = 1").drop("_bit", "_bucket", "_part")


def text_of(name: str) -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
