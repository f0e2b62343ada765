"""Line deduplication over overlapping three-line windows (operator 9, DataFrame functions only).

Every run of three consecutive lines is hashed (128 bits). A window that occurs more than once
stays where it occurs first, by (doc_id, position); the lines that later occurrences cover are
merged into intervals per document, and the text is rebuilt from the slices between them.
Aggregates find the first occurrences, so a window that a third of all documents hold is combined
before the shuffle, and the join back is one that adaptive execution can split.

With ``long_words``, shorter runs of whole lines that hold more words than that are windows too, so a
long passage on one or two lines is found between any neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_of

WINDOW_LINES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _long_runs(n: int, long_words: int) -> Column:
    """The runs of n lines that hold more than long_words words, by the columns lines and words (of each
    line). A document of n lines or fewer has none: it is one window as it is."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("lines") - n, F.lit(0))), lambda i: (F.size("lines") > n) & (sum((F.get("words", i + k) for k in range(1, n)), F.get("words", i)) > long_words))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"), F.concat_ws("\n", F.slice("lines", i + 1, n)).alias("joined")))


def window_rows(docs: DataFrame, id_col: str, text_col: str, size: int, long_words: int | None = None) -> DataFrame:
    """(doc_id, mark, pos, n, window): a row for each window of n lines of each distinct (doc_id, text).
    A document of fewer lines than a window has one window of all its lines. Windows without any
    visible character are left out."""
    text = text_of(text_col)
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), _lines(text).alias("lines"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("lines") - size, F.lit(0)))
    windows = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(size).alias("n"), F.concat_ws("\n", F.slice("lines", i + 1, size)).alias("joined")))
    if long_words is not None:
        # Each line is counted once, for all runs that it is in.
        lines = lines.withColumn("words", F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"\S+"))))
        windows = F.concat(windows, *(_long_runs(n, long_words) for n in range(1, size)))
    rows = lines.select("doc_id", "mark", F.inline(windows))
    return rows.where(F.col("joined").rlike(r"\S")).select("doc_id", "mark", "pos", "n", F.unhex(F.md5("joined")).alias("window"))


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW_LINES, long_words: int | None = None) -> DataFrame:
    """(doc_id, mark, spans): per document with lines to remove, the merged intervals [start, stop)."""
    rows = window_rows(docs, id_col, text_col, size, long_words)
    here = F.struct("doc_id", "mark", "pos")
    # min and max differ exactly if the window occurs at two places; repeated rows are one place.
    first = rows.groupBy("window").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first != last").drop("last")
    # A written table: the join below then shuffles both sides, so a window that many documents share
    # can be split over tasks.
    first = stage(first, "repeated-windows")
    later = rows.join(first, "window").where(~here.eqNullSafe(F.col("first"))).select("doc_id", "mark", "pos", "n").distinct()
    order = Window.partitionBy("doc_id", "mark").orderBy("pos", "n")
    before = F.max(F.col("pos") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("pos") > before, F.lit(True))
    islands = later.withColumn("apart", apart.cast("int")).withColumn("island", F.sum("apart").over(order))
    merged = islands.groupBy("doc_id", "mark", "island").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("n")).alias("stop"))
    return merged.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW_LINES, long_words: int | None = None) -> DataFrame:
    """The input rows with all their columns, the text without its later occurrences, and three
    columns more: _n_lines (before), _n_removed, _emptied (a text that lost its last line).

    Lines end at ``\\n`` only. A null text counts as empty: one line, nothing to remove; it comes out
    as an empty text. The first occurrence is the one with the smallest (id, position), null ids
    first, ties by a hash of the text. Rows that repeat both id and text count as one document and
    come out alike. Windows that repeat inside a document are removed there too. An empty table
    gives an empty table. A very long text is one row with all its lines, before and after. Input
    columns of the three added names are replaced. long_words: runs of
    fewer than size lines with more words than that (apart by white space) count as windows too.
    """
    text = text_of(text_col)
    kept = [c for c in docs.columns if c not in ("_n_lines", "_n_removed", "_emptied")]
    # The other columns travel in a struct, so their names can't clash with those used here.
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept) if c != text_col))
    left = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    joined = left.join(covered(docs, id_col, text_col, size, long_words), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("mark")), "left")
    lines = _lines(F.col("text"))
    n = F.size(lines)
    edges = F.concat(F.array(F.lit(0)), F.flatten(F.transform("spans", lambda s: F.array(s["start"], F.least(s["stop"], n)))), F.array(n))
    # edges: keep from, keep to, keep from, keep to, ...
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("spans")),
        lambda i: F.slice(lines, F.get(edges, i * 2) + 1, F.get(edges, i * 2 + 1) - F.get(edges, i * 2)),
    )
    whole = F.col("spans").isNull()
    out = joined.withColumn("rest", F.when(whole, lines).otherwise(F.flatten(pieces)))
    new_text = F.when(whole, F.col("text")).otherwise(F.array_join("rest", "\n"))
    return out.select(
        *((new_text if c == text_col else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(kept)),
        n.alias("_n_lines"),
        (n - F.size("rest")).alias("_n_removed"),
        ((F.size("rest") == 0) & ~whole).alias("_emptied"),
    )
