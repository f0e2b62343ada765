"""Incremental sync: what to do with each session given the notes written so far."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stage
from . import messages as M
from . import notes as N

#: What can become of a session.
CREATED, APPENDED, UNCHANGED, SKIPPED, FAILED = "created", "appended", "unchanged", "skipped", "failed"


#: What a created note's name must be when the run is committed: free.
FREE = -1


@dataclass(frozen=True)
class Notes:
    """What is known of a folder's notes. heads: session_id, filename, msg_count, headings, modified (ms, or null if
    it does not matter); names: filename of each. Of the notes listed (filename), so that no other is looked at: texts
    gives filename and markdown; marks gives filename, head (the front matter with its two lines), head_bytes, and q and
    a, how many headings of messages they have outside code."""

    heads: DataFrame
    names: DataFrame
    texts: Callable[[DataFrame], DataFrame]
    marks: Callable[[DataFrame], DataFrame]


def of_snapshot(notes: DataFrame) -> Notes:
    """Of a table of whole notes. It may be read from files, so what notes say of themselves is a written table."""
    told = stage(notes.select("session_id", "filename", F.col("msg_count").cast("int").alias("msg_count"), "headings"), "told-notes")
    heads = told.withColumn("modified", F.lit(None).cast("long"))
    texts = lambda names: notes.select("filename", "markdown").join(names, "filename", "left_semi")
    return Notes(heads, told.select("filename"), texts, lambda names: N.marks(texts(names)))


def one_note_each(notes: DataFrame) -> DataFrame:
    """One note of each session: the one with the smallest file name."""
    named = notes.where("session_id IS NOT NULL")
    return named.groupBy("session_id").agg(F.min_by(F.struct(*(c for c in notes.columns if c != "session_id")), "filename").alias("note")).select("session_id", "note.*")


def notes_reached(messages: DataFrame, notes: DataFrame) -> DataFrame:
    """notes with msg_count, q_count and a_count: how many of their session's messages (session_id, seq,
    role, text, in order) they hold. headings counts the lines of a note that begin like a heading; a
    message has one of its own and those in its text."""
    # Headings are counted before the join, so that no text is shuffled.
    told = messages.select("session_id", "seq", "role", (N.heading_count(F.coalesce("text", F.lit(""))) + 1).alias("_headings"))
    here = told.join(notes.select("session_id", F.col("headings").alias("_held")), "session_id")
    so_far = F.sum("_headings").over(M.by_session().rowsBetween(Window.unboundedPreceding, 0))
    inside = here.withColumn("_in", so_far <= F.col("_held")).where("_in")
    own = inside.groupBy("session_id").agg(F.count(F.lit(1)).alias("msg_count"), *(F.count_if(F.col("role") == r).alias(c) for r, c in zip(M.ROLES, ("q_count", "a_count"))))
    kept = notes.drop("msg_count", "q_count", "a_count").join(own, "session_id", "left")
    return kept.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("msg_count", "q_count", "a_count")})


def action(current: str = "msg_count", existing: str = "old_count", found: str = "found", worth: str | None = None) -> Column:
    """By the counts of messages now and in the note. found: whether there is a note; a note without a
    valid count is damaged and left alone. worth: whether the session gets a note at all, by default
    if it has messages."""
    empty = F.col(current) == 0 if worth is None else ~F.col(worth)
    return (
        F.when(empty, SKIPPED)
        .when(~F.col(found), CREATED)
        .when(F.col(existing).isNull(), SKIPPED)
        .when(F.col(current) <= F.col(existing), UNCHANGED)
        .otherwise(APPENDED)
    )


def dispatch(sessions: DataFrame, notes: DataFrame) -> DataFrame:
    """sessions (session_id, msg_count, perhaps worth, ...) with old_count, found and action; notes
    (session_id, msg_count, q_count, a_count, filename) hold one row of each session at most."""
    old = notes.select("session_id", F.col("msg_count").alias("old_count"), F.col("q_count").alias("old_q"), F.col("a_count").alias("old_a"), F.col("filename").alias("old_filename"), F.lit(True).alias("found"))
    joined = sessions.join(old, "session_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return joined.withColumn("action", action(worth="worth" if "worth" in sessions.columns else None))


def new_messages(messages: DataFrame, dispatched: DataFrame) -> DataFrame:
    """The messages of created and appended sessions that their notes lack, numbered on."""
    due = dispatched.where(F.col("action").isin(CREATED, APPENDED)).select("session_id", F.coalesce("old_count", F.lit(0)).alias("skip"), F.coalesce("old_q", F.lit(0)).alias("q0"), F.coalesce("old_a", F.lit(0)).alias("a0"))
    # Joined first: no text of sessions that are not due is shuffled or sorted.
    late = M.positions(messages.join(due, "session_id")).where("position > skip")
    return M.numbered(late, F.col("q0"), F.col("a0")).drop("skip", "q0", "a0")


@dataclass(frozen=True)
class Synced:
    """What becomes of each session, and what is to be written, by message: no note is held in one row.

    rows: session_id, action, from_count, to_count, filename, expects, front, keep_from and perhaps more. filename and
    front are null where nothing is to be written. expects is what the sink must find there: FREE for a created note, the
    time of the one appended to. front is what the note begins with; keep_from, null for created notes, the byte from which the
    note held stays as it is behind that. blocks: session_id, seq, block: what follows, in order. texts: see Notes."""

    rows: DataFrame
    blocks: DataFrame
    texts: Callable[[DataFrame], DataFrame]
    dialect: N.Dialect

    def whole(self) -> DataFrame:
        """rows with markdown in place of front and keep_from: each note as one string, 2 GB at most."""
        pieces = F.array_sort(F.collect_list(F.struct("seq", "block")))
        body = self.blocks.groupBy("session_id").agg(F.array_join(F.transform(pieces, lambda p: p["block"]), "").alias("_body"))
        grown = self.rows.where(F.col("action") == APPENDED).select("filename")
        held = self.texts(grown).select("filename", F.col("markdown").alias("_held"))
        joined = self.rows.join(body, "session_id", "left").join(held, "filename", "left").withColumn("_body", F.coalesce("_body", F.lit("")))
        appended = F.concat(F.regexp_replace("_held", r"(?<!\n)\n*\z", "\n\n"), F.col("_body"))
        if self.dialect.has_msg_count:
            appended = N.with_msg_count(appended, F.col("to_count"))
        markdown = F.when(F.col("action") == CREATED, F.concat("front", "_body")).when(F.col("action") == APPENDED, appended)
        columns = [c for c in self.rows.columns if c not in ("front", "keep_from", "expects")]
        at = columns.index("filename") + 1
        return joined.select(*columns[:at], markdown.alias("markdown"), "expects", *columns[at:])


def synced(messages: DataFrame, sessions: DataFrame, notes: Notes, dialect: N.Dialect) -> Synced:
    """sessions: session_id, date, title, source, msg_count, worth; messages: the spoken ones, seq in order; notes may
    have any number of a session. Where the dialect stores no count, it is told by the headings. Only notes that are
    appended to are looked at, and none of their text is moved."""
    held = one_note_each(notes.heads).withColumns({"q_count": F.lit(0), "a_count": F.lit(0)})
    dispatched = stage(dispatch(sessions, held if dialect.has_msg_count else notes_reached(messages, held)), "dispatched")
    appended_to = F.when(F.col("action") == APPENDED, F.col("old_filename"))
    numbered = dispatched
    front, keep_from = F.lit(""), F.lit(0)
    if dialect.has_msg_count:
        grown = stage(dispatched.where(F.col("action") == APPENDED).select(F.col("old_filename").alias("filename")), "appended-names")
        marks = stage(notes.marks(grown), "appended-marks").select(F.col("filename").alias("old_filename"), "head", "head_bytes", F.col("q").alias("old_q"), F.col("a").alias("old_a"))
        numbered = dispatched.drop("old_q", "old_a").join(marks, "old_filename", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("old_q", "old_a")})
        front, keep_from = N.with_msg_count(F.col("head"), F.col("msg_count")), F.col("head_bytes")
    late = new_messages(messages, numbered)
    due = dispatched.where(F.col("action") == CREATED).select("session_id", N.base_name(dialect).alias("base"))
    # The beginnings of ids, in whose order names are given, follow that order.
    named = N.free_names(due, "base", notes.names, ["session_id"], F.substring("session_id", 1, 12)).select("session_id", "filename")
    times = held.select(F.col("filename").alias("appended_to"), F.col("modified").alias("old_modified"))
    joined = numbered.withColumn("appended_to", appended_to).join(times, "appended_to", "left").join(named, "session_id", "left")
    written = F.col("action").isin(CREATED, APPENDED)
    created, appended = F.col("action") == CREATED, F.col("action") == APPENDED
    rows = joined.select(
        "session_id",
        "action",
        F.coalesce("old_count", F.lit(0)).cast("long").alias("from_count"),
        F.when(written, F.col("msg_count")).otherwise(F.coalesce("old_count", F.lit(0))).cast("long").alias("to_count"),
        F.when(created, F.col("filename")).otherwise(F.col("appended_to")).alias("filename"),
        F.when(created, F.lit(FREE)).when(appended, F.col("old_modified")).cast("long").alias("expects"),
        F.when(created, N.front_matter(dialect)).when(appended, front).alias("front"),
        F.when(appended, keep_from).cast("long").alias("keep_from"),
    )
    return Synced(rows, late.select("session_id", F.col("seq").cast("long").alias("seq"), M.block().alias("block")), notes.texts, dialect)


def outcomes(rows: DataFrame) -> DataFrame:
    """How many sessions had each outcome."""
    return rows.groupBy("action").agg(F.count(F.lit(1)).alias("sessions"))


def not_from(catalogue: DataFrame, source: str) -> DataFrame:
    """Catalogue rows of other sources; a missing source passes."""
    return catalogue.where(~F.col("source").eqNullSafe(F.lit(source)))
