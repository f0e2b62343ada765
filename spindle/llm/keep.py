"""Let an operator's decisions about (doc_id, mark) take effect on a table of documents.

mark is xxhash64 of the text, null as empty, so rows that share an id (or have none) but not their
text are told apart. All columns of the documents are kept as they are, whatever their names; texts of
any length, null and empty ones too. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

KEYS = ["k_null", "k_id", "k_mark"]


def _keys(id_col: str, mark):
    return [F.col(id_col).isNull().alias(KEYS[0]), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(KEYS[1]), mark.alias(KEYS[2])]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns in a struct, so that their names can't clash with the keys."""
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    return docs.select(row.alias("row"), *_keys(id_col, F.xxhash64(text_of(text_col))))


def _unkeyed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def without(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not in found (doc_id, mark)."""
    gone = found.select(*_keys("doc_id", F.col("mark"))).distinct()
    return _unkeyed(_keyed(docs, id_col, text_col).join(gone, KEYS, "left_anti"), docs)


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of groups (doc_id, mark, component): the smallest id, null ids
    last. Rows that repeat id and text are one document. Those without a component stay all."""
    first = groups.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("k"))
    chosen = first.select("k.doc_id", "k.mark").select(*_keys("doc_id", F.col("mark")))
    alone = groups.where("component IS NULL").select("doc_id", "mark").distinct().select(*_keys("doc_id", F.col("mark")), F.lit(True).alias("all"))
    named = chosen.withColumn("all", F.lit(False)).unionByName(alone)
    joined = _keyed(docs, id_col, text_col).join(named, KEYS)
    # Partitioned by the keys already, so this adds no shuffle; copies of blank texts differ by row.
    each = joined.withColumn("copy", F.when(F.col("all"), F.monotonically_increasing_id()))
    return _unkeyed(each.dropDuplicates([*KEYS, "copy"]), docs)
