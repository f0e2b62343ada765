"""Sync that follows what arrives: a run of a sync for each batch of hook events, or of new lines in rollout files.

A stream of hook events only says that something came, and perhaps for which sessions; each run reads the transcripts of
these. The stream over rollout files that grow reads the new lines alone and keeps them as a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import sync as S
from ..plans import pipelines
from ..sources import grown, note_files, transcripts
from ..sources.shared import stage


def _alone(spark: SparkSession, folder: str, run: Callable[[S.Notes | None], DataFrame | S.Synced], whole: bool | None, index: str | None = None, **sinks) -> DataFrame | None:
    """Write what run makes of the notes held; None if another run holds the folder. whole: whether headings are
    counted; None: the notes held do not matter."""
    real = note_files.guard(folder)
    with note_files.lock(real) as token:
        if token is None:
            return None
        held = None if whole is None else transcripts.held_notes(spark, real, index, whole)
        return pipelines.write(run(held), real, index=index, token=token, **sinks)


def sync_now(spark: SparkSession, sessions: str, folder: str, **sinks) -> DataFrame | None:
    """One run over the rollout files."""
    return _alone(spark, folder, lambda held: pipelines.plan_rollouts(spark, sessions, held), False, **sinks)


def sync_sessions_now(spark: SparkSession, catalogue: str, documents: str, logs: str | list[str] | None, folder: str, wanted: DataFrame | None = None, **sinks) -> DataFrame | None:
    """One run over the wanted sessions (session_id), or all of the catalogue that no rollout file has;
    what documents lack is read from the event logs. Only documents of these sessions, and only logs of those
    without a document that can be read, are opened."""

    def run(held: S.Notes) -> S.Synced:
        due = S.not_from(transcripts.session_catalogue(spark, catalogue), "codex") if wanted is None else wanted
        due = stage(due.select("session_id").distinct(), "due")
        fallback = None if logs is None else lambda missing, held: transcripts.event_log_documents(spark, logs, wanted=missing, held=held)
        return pipelines.plan_sessions(spark, transcripts.session_documents(spark, documents, due), held, due, fallback)

    return _alone(spark, folder, run, True, **sinks)


def export_now(spark: SparkSession, path: str, folder: str, **sinks) -> DataFrame | None:
    """One run over an export; all its notes are written anew."""
    return _alone(spark, folder, lambda _: pipelines.export_notes(spark, path), None, **sinks)


def follow(triggers: DataFrame, run: Callable[[DataFrame], object], checkpoint: str) -> StreamingQuery:
    """Call run with each batch of a stream of hook events that holds any."""
    return (
        triggers.writeStream.foreachBatch(lambda batch, _: None if batch.isEmpty() else run(batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def follow_rollouts(spark: SparkSession, sessions: str, folder: str, table: str, checkpoint: str, **sinks) -> StreamingQuery:
    """Follow the rollout files below a folder as they grow: only new lines are read, added to a table of events,
    and the sessions that they touch are synced from it. Where another run holds the notes, the batch fails and
    is run again by the next start; one that is run twice changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        events = transcripts.rollout_events(transcripts.grown_rollout_lines(batch), "anew")
        due = pipelines.keep_rollout_batch(events, table, number)
        if due is not None and _alone(spark, folder, lambda held: pipelines.plan_rollout_events(spark, due, held), False, **sinks) is None:
            raise RuntimeError(f"another run holds {folder}")

    lines = grown.grown_lines(spark, sessions, "rollout-*.jsonl")
    return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hooked(batch: DataFrame) -> DataFrame | None:
    """The sessions that a batch of hook events (session_id) names; None, for all, if one names none."""
    if not batch.where("coalesce(session_id, '') = ''").isEmpty():
        return None
    return batch.select("session_id").distinct()
