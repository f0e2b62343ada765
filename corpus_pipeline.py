"""The corpus pipeline: documents to training sequences in five stages.

Each stage is (name, function(spark, docs, sf_dir)). All but the last return the columns of
``documents``; a stage's table is written and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import decontaminate, keep, line_dedup, minhash, packing, toxicity
from spindle.llm.common import documents, stage, table
from spindle.llm.encoding import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go; it learns from the labelled ones. A null or empty text
    has no features and stays, a very long one is scored whole; rows that repeat are judged alike, null ids
    like others. Without documents or labels nothing goes."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(~F.col("_toxic")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows, and of one or two lines of more than 50 words, are cut
    out; a document that loses all its lines goes. A null text comes out empty. The first occurrence is that of
    the smallest id (null ids first), ties by a hash of the text; rows that repeat id and text count as one
    document and come out alike. A very long text is read whole. An empty table gives an empty table."""
    cut = line_dedup.line_dedup(docs, long_words=50).where(~F.col("_emptied"))
    return cut.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, by the sets and the similarity of the operator's
    contract (two-word shingles, 0.8): the one with the smallest id, null ids last. Rows that repeat id
    and text are one document. Null and empty texts are near nothing and stay all; very long ones are compared
    by whole sets. An empty table gives an empty table."""
    return keep.one_of_each(docs, minhash.near_duplicates(docs, size=2))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go. Null and empty texts hold none
    and stay; very long ones are read whole; rows that repeat, and those that share an id or have none, are told apart
    by their texts. Without documents or items nothing goes."""
    return keep.without(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, placed in sequences of 1,024 tokens. A null or empty text is one
    piece of one id, a very long one is many full pieces and a rest; rows that repeat are packed each on
    their own, null ids too. An empty table gives an empty table."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Model fitting and tokenising can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
