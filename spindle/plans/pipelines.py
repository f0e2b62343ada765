"""The three pipelines end to end: transcripts to notes. Each returns one row per session with its
outcome; ``write`` puts the notes in place.

Transcripts are parsed once a run: what is read from them is a written table, which all later steps,
and the retry of a lost executor, read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import messages as M
from ..operators import notes as N
from ..operators import sync as S
from ..operators.running import block_of
from ..sources import note_files
from ..sources import transcripts as R
from ..sources.shared import stage

#: Fixed value: why a session was read from its event log.
FROM_EVENT_LOG = "from the event log"


def export_notes(spark: SparkSession, path: str) -> DataFrame:
    """All notes of an export, anew: session_id, action, filename, markdown. Conversations without
    messages are skipped; names that repeat are numbered in the order of the export."""
    parsed = R.export_conversations(spark, path)
    said = R.export_messages(parsed).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text"))).alias("said"))
    conversations = stage(parsed.select("session_id", "file", "at", "title", T.date_from_epoch(F.col("started_at")).alias("date")).join(said, "session_id", "left"), "export")
    body = M.rendered(M.numbered(conversations.select("session_id", F.inline("said"))))
    rows = conversations.drop("said").join(body, "session_id", "left")
    made = rows.where("body IS NOT NULL").withColumn("base", N.base_name(N.EXPORT))
    named = N.numbered_names(made, "base", ["file", "at"], F.struct("file", block_of("at")))
    written = named.select("session_id", F.lit(S.CREATED).alias("action"), "filename", N.markdown(N.EXPORT).alias("markdown"))
    none = F.lit(None).cast("string")
    return written.unionByName(rows.where("body IS NULL").select("session_id", F.lit(S.SKIPPED).alias("action"), none.alias("filename"), none.alias("markdown")))


def _with_failed(made: S.Synced, failed: DataFrame) -> S.Synced:
    """With rows of the sessions that failed (session_id, reason); the rows made have a reason."""
    values = {"action": F.lit(S.FAILED), "from_count": F.lit(0), "to_count": F.lit(0), "session_id": F.col("session_id"), "reason": F.col("reason")}
    rows = failed.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in made.rows.schema))
    return replace(made, rows=made.rows.unionByName(rows))


def _notes(spark: SparkSession, notes: S.Notes | DataFrame | None) -> S.Notes:
    if notes is None:
        notes = spark.createDataFrame([], "session_id string, filename string, markdown string, msg_count long, headings long")
    return notes if isinstance(notes, S.Notes) else S.of_snapshot(notes)


#: Gives the documents of sessions (session_id) that are wanted, or all if None, and are not held.
Fallback = Callable[[DataFrame | None, DataFrame], DataFrame]


def _read(documents: DataFrame, used_fallback: bool) -> DataFrame:
    """A written table of the sessions of some documents: session_id, source, used_fallback, date, reason (why one
    fails, or null) and said (its messages)."""
    date = T.date_prefix(F.col("started_at"))
    reason = F.when((F.col("source") == "") | (F.col("started_at") == ""), "missing timestamp or source").when(~T.has_date_shape(date), "bad date")
    checked = documents.select("session_id", "source", F.lit(used_fallback).alias("used_fallback"), date.alias("date"), reason.alias("reason"), "items")
    return stage(checked.select("*", F.when(F.col("reason").isNull(), R.said(F.col("items"))).alias("said")).drop("items"), "sessions")


def plan_sessions(spark: SparkSession, documents: DataFrame, notes: S.Notes | DataFrame | None = None, wanted: DataFrame | None = None, fallback: Fallback | None = None) -> S.Synced:
    """What becomes of sessions (of wanted, or all), and why one fails.

    A session that documents lack is taken from fallback (event logs), which its reason says; the fallback
    is asked only for such sessions, and only if there are any. The high-water mark is how many of the session's
    messages the note holds: the longest beginning of them that has no more headings, those inside its
    messages included, than the note. So a heading inside a message, or code that is never closed, hides no
    later message and repeats none. A session without any message is skipped; one with system messages
    only still gets a note of its heading. Names that are taken get a number.
    """
    if wanted is not None:
        wanted = stage(wanted.select("session_id").distinct(), "wanted")
        documents = documents.join(wanted, "session_id", "left_semi")
    read = _read(documents, False)
    if fallback is not None:
        missing = None if wanted is None else wanted.join(read, "session_id", "left_anti")
        if missing is None or not missing.isEmpty():
            read = read.unionByName(_read(fallback(missing, read.select("session_id")), True))
    if wanted is not None:
        read = wanted.join(read, "session_id", "left").withColumn("reason", F.when(F.col("used_fallback").isNull(), "can't be read").otherwise(F.col("reason")))
    all_messages = read.where("said IS NOT NULL").select("session_id", F.inline("said"))
    spoken = M.spoken(all_messages).drop("title")
    sessions = read.where("reason IS NULL").select("session_id", "source", "date").join(M.facts_of_titled(all_messages), "session_id", "left")
    counted = sessions.withColumn("title", F.coalesce("title", F.lit(T.UNTITLED))).withColumn("msg_count", F.coalesce("qa_count", F.lit(0))).withColumn("worth", F.coalesce("all_count", F.lit(0)) > 0)
    made = S.synced(spoken, counted, _notes(spark, notes), N.SESSION)
    why = read.where("used_fallback").select("session_id", F.lit(FROM_EVENT_LOG).alias("reason"))
    return _with_failed(replace(made, rows=made.rows.join(why, "session_id", "left")), read.where("reason IS NOT NULL"))


def sync_sessions(spark: SparkSession, documents: DataFrame, notes: S.Notes | DataFrame | None = None, wanted: DataFrame | None = None, fallback: Fallback | None = None) -> DataFrame:
    """plan_sessions with whole notes: session_id, action, from_count, to_count, filename, markdown, expects, reason."""
    return plan_sessions(spark, documents, notes, wanted, fallback).whole()


def plan_rollouts(spark: SparkSession, folder: str, notes: S.Notes | DataFrame | None = None) -> S.Synced:
    """Rollout files. The high-water mark is the msg_count that the note stores. Of files with the same session
    id, the smallest path counts."""
    return plan_rollout_events(spark, stage(R.rollout_events(R.rollout_lines(spark, folder)), "rollout-events"), notes)


def sync_rollouts(spark: SparkSession, folder: str, notes: S.Notes | DataFrame | None = None) -> DataFrame:
    """plan_rollouts with whole notes: the columns of sync_sessions."""
    return plan_rollouts(spark, folder, notes).whole()


def plan_rollout_events(spark: SparkSession, events: DataFrame, notes: S.Notes | DataFrame | None = None) -> S.Synced:
    """plan_rollouts of a written table of rollout events (path, place, session, said) that holds whole files."""
    checked = R.rollout_validated(R.rollout_sessions(events))
    good = checked.where("reason IS NULL").groupBy("session_id").agg(F.min_by(F.struct("path", "date"), "path").alias("m")).select("session_id", "m.*")
    # Titles are found where the messages are read, not in the few tasks that a shuffle may leave.
    said = R.rollout_messages(events).withColumn("title", T.title_of(F.col("text"))).join(good.select("session_id", "path"), "path")
    spoken = said.select("session_id", "seq", "role", "text")
    sessions = good.join(M.facts_of_titled(said), "session_id", "left")
    sessions = sessions.select("session_id", "date", F.lit("codex").alias("source"), F.coalesce("title", F.lit(T.UNTITLED)).alias("title"), F.coalesce("qa_count", F.lit(0)).alias("msg_count"))
    made = S.synced(spoken, sessions.withColumn("worth", F.col("msg_count") > 0), _notes(spark, notes), N.ROLLOUT)
    return _with_failed(replace(made, rows=made.rows.withColumn("reason", F.lit(None).cast("string"))), checked.where("reason IS NOT NULL"))


#: Parts into which the events of a stream are dealt by path.
PARTS = 64


def keep_rollout_batch(events: DataFrame, table: str, batch: int) -> DataFrame | None:
    """Add a batch of grown rollout events (path, place, anew, session, said) to a table, and return all events of the
    files of the sessions that it touches; None if it touches none. The table has a folder for each batch, which a batch
    that is run again replaces. Events from before a file was read anew are left out."""
    spark = events.sparkSession
    part = F.pmod(F.xxhash64("path"), F.lit(PARTS)).cast("int")
    fields = {f.name: f.dataType for f in events.schema}
    shape = ", ".join(f"{n} {fields[n].simpleString()}" for n in ("path", "place", "anew", "session", "said"))
    events.select("path", "place", "anew", "session", "said", part.alias("part")).write.partitionBy("part").mode("overwrite").parquet(f"{table}/events/batch={batch}")
    own = spark.read.schema(f"{shape}, part int").parquet(f"{table}/events/batch={batch}")
    # Small: a row for each file that the batch touches, with the session that its first line names.
    sessions = own.groupBy("path").agg(F.max("anew").alias("anew"), F.min_by("session.session_id", F.when(F.col("session").isNotNull(), F.col("place"))).alias("session_id"))
    sessions.write.mode("overwrite").parquet(f"{table}/files/batch={batch}")
    files = spark.read.schema("path string, anew boolean, session_id string, batch long").parquet(f"{table}/files").where(F.col("batch") <= batch)
    touched = stage(files.where(F.col("batch") == batch).select("path"), "touched")
    if touched.isEmpty():
        return None
    since = files.groupBy("path").agg(F.max(F.when(F.col("anew"), F.col("batch"))).alias("since"))
    current = files.join(since, "path").where(F.col("batch") >= F.col("since")).groupBy("path", "since").agg(F.min_by("session_id", F.when(F.col("session_id").isNotNull(), F.col("batch"))).alias("session_id"))
    current = stage(current, "current-files")
    # With the other files of the same sessions, since the smallest path counts.
    ids = current.join(touched, "path", "left_semi").select("session_id")
    due = stage(current.join(touched, "path", "left_semi").unionByName(current.join(ids, "session_id", "left_semi")).select("path", "since").distinct(), "due-files")
    parts = [r[0] for r in due.select(part.alias("part")).distinct().collect()]  # PARTS at most
    held = spark.read.schema(f"{shape}, batch long, part int").parquet(f"{table}/events").where(F.col("part").isin(parts) & (F.col("batch") <= batch))
    return stage(held.join(due, "path").where(F.col("batch") >= F.col("since")).select("path", "place", "session", "said"), "due-events")


def write(rows: DataFrame | S.Synced, folder: str, sync: bool = True, index: str | None = None, log: str | None = None, token: str | None = None) -> DataFrame:
    """Write the notes that rows hold, or that are planned, all or none, and return the number of sessions by outcome.
    The plan reads the folder that is written to, so rows are a written table before the first note is. Notes that are
    planned are written message by message, and may be of any length.

    index: a folder to whose table the created notes' session_id and filename are appended. log: one
    to which each session's outcome is appended, with the time of the run. token: of the folder's lock.
    """
    if isinstance(rows, S.Synced):
        kept = stage(rows.rows, "notes")
        note_files.write_blocks(kept.where("front IS NOT NULL"), rows.blocks, folder, sync, token)
    else:
        kept = stage(rows, "notes")
        note_files.write_notes(kept.where("markdown IS NOT NULL"), folder, sync, token)
    if index is not None:
        R.append_index(kept.where(F.col("action") == S.CREATED), index)
    if log is not None:
        optional = [F.col(c) for c in ("from_count", "to_count", "reason") if c in kept.columns]
        kept.select(F.current_timestamp().alias("at"), "session_id", "action", "filename", *optional).write.mode("append").json(log)
    return S.outcomes(kept)
