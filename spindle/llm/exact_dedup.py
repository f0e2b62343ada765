"""Exact deduplication with a heavy-hitter split (operator 1, DataFrame functions only).

Misra-Gries summaries of ``counters`` digests (Spark's approx_top_k sketches, a weighted Misra-Gries
summary that can be merged) are made per partition, merged per group of partitions, then into one.
The digests it names are verified: their exact counts and winning rows come from a map-side partial
aggregate. They are ``counters`` rows at most, so the broadcast that decides all their copies without
a shuffle has a size bound that does not depend on the data. All other digests are grouped by an
ordinary shuffle; none of them is frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage, text_of


#: Partitions whose summaries are merged in one task of the first round.
MERGED = 256


def _frequent(rows: DataFrame, counters: int) -> DataFrame:
    """(digest): the digests that the merged summary holds, ``counters`` at most; all with more than
    about 2 / counters of the rows are among them."""
    parts = rows.select("digest", F.floor(F.spark_partition_id() / MERGED).alias("part"))
    by_part = parts.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(digest, {counters})").alias("summary"))
    # Grouped by a constant: the sketch of an empty task without groups is null and can't be merged.
    merged = by_part.groupBy(F.col("part") * 0).agg(F.expr(f"approx_top_k_combine(summary, {counters})").alias("summary"))
    return merged.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {counters})")).alias("found")).select(F.col("found.item").alias("digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, and all
    empty texts are one group. The row with the largest id stays (a null id is smaller than any
    other). Rows that repeat both text and id are told apart by an internal row number, so exactly
    one row of each group has ``kept``. A very long text is hashed whole where it is read; only digests are
    shuffled. An empty table gives an empty table. Columns besides id
    and text are ignored, whatever their names.
    """
    rows = stage(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(ascii_lower(text_of(text_col)), 256).alias("digest")).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "digests",
    )
    winner = [F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")]
    frequent = _frequent(rows, counters)
    # Staged, as a summary computed anew could name other digests.
    heavy = stage(rows.join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest").agg(*winner), "heavy-digests")
    decided = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy), "digest", "left_anti")
    grouped = rest.join(rest.groupBy("digest").agg(*winner), "digest")
    return decided.unionByName(grouped).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
