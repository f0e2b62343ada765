"""Operators on canonical messages: (session_id, seq, role, text), seq the position in the session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .running import block_of, running_counts

ROLES = ("user", "assistant")
#: Fixed value: messages that the event-log reader takes of a session at most.
MESSAGE_CAP = 2000


def spoken(messages: DataFrame) -> DataFrame:
    """Only what user and assistant said."""
    return messages.where(F.col("role").isin(*ROLES))


def without_context(messages: DataFrame) -> DataFrame:
    """Without user messages that only carry context for the assistant."""
    context = (F.col("role") == "user") & T.starts_with_any(T.lstrip(F.col("text")), T.CONTEXT_STARTS)
    return messages.where(~F.coalesce(context, F.lit(False)))


def without_blank(messages: DataFrame) -> DataFrame:
    return messages.where(~T.is_blank(F.col("text")))


def by_session() -> "Window":
    return Window.partitionBy("session_id").orderBy("seq")


def positions(messages: DataFrame) -> DataFrame:
    """position: 1, 2, ... in the session, by seq."""
    return messages.withColumn("position", F.row_number().over(by_session()).cast("long"))


def capped(messages: DataFrame, cap: int = MESSAGE_CAP) -> DataFrame:
    """The first ``cap`` messages of each session, in blocks of positions: a session may be of any length."""
    counted = running_counts(messages, "session_id", block_of("seq"), ["seq"], {"_position": F.lit(True)})
    return counted.where(F.col("_position") <= cap).drop("_position")


def numbered(messages: DataFrame, q_before: Column | None = None, a_before: Column | None = None) -> DataFrame:
    """n: the running number of each message among those of its role, after those before."""
    frame = by_session().rowsBetween(Window.unboundedPreceding, 0)
    q, a = (F.sum(F.when(F.col("role") == r, 1).otherwise(0)).over(frame) for r in ROLES)
    q, a = q + (0 if q_before is None else q_before), a + (0 if a_before is None else a_before)
    return messages.withColumn("n", F.when(F.col("role") == "user", q).otherwise(a))


def block() -> Column:
    """A message as a heading and its text, with an empty line after it."""
    return F.concat(F.lit("## "), F.when(F.col("role") == "user", "Q").otherwise("A"), F.col("n").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"))


def rendered(messages: DataFrame, *keys: str) -> DataFrame:
    """body, msg_count, q_count and a_count of each session; messages have n."""
    pieces = F.array_sort(F.collect_list(F.struct("seq", block().alias("block"))))
    return messages.groupBy("session_id", *keys).agg(
        F.array_join(F.transform(pieces, lambda p: p["block"]), "").alias("body"),
        F.count(F.lit(1)).alias("msg_count"),
        F.count_if(F.col("role") == "user").alias("q_count"),
        F.count_if(F.col("role") == "assistant").alias("a_count"),
    )


def _count_columns() -> list[Column]:
    return [F.count(F.lit(1)).alias("all_count"), F.count_if(F.col("role").isin(*ROLES)).alias("qa_count")]


def _title_column() -> Column:
    """Of the first user message that gives a title, or else the first assistant message, or else
    untitled; over the columns role, seq and title."""
    first = [F.min_by("title", F.when((F.col("role") == r) & F.col("title").isNotNull(), F.col("seq"))) for r in ROLES]
    return F.coalesce(*first, F.lit(T.UNTITLED)).alias("title")


def _with_titles(messages: DataFrame, text: Column | None) -> DataFrame:
    return messages.select("session_id", "seq", "role", T.title_of(F.col("text") if text is None else text).alias("title"))


def counts(messages: DataFrame) -> DataFrame:
    """all_count (any role) and qa_count of each session."""
    return messages.groupBy("session_id").agg(*_count_columns())


def titles(messages: DataFrame, text: Column | None = None) -> DataFrame:
    """The title of each session."""
    return _with_titles(messages, text).groupBy("session_id").agg(_title_column())


def facts(messages: DataFrame, text: Column | None = None) -> DataFrame:
    """Counts and title of each session in one aggregate."""
    return facts_of_titled(_with_titles(messages, text))


def facts_of_titled(messages: DataFrame) -> DataFrame:
    """The same of messages that have what each could give as a title."""
    return messages.groupBy("session_id").agg(*_count_columns(), _title_column())


def united(**sources: DataFrame) -> DataFrame:
    """The messages of several sources in one frame: source, session_id, seq, role, text."""
    frames = [m.select(F.lit(name).alias("source"), F.col("session_id").cast("string").alias("session_id"), "seq", "role", "text") for name, m in sources.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
