"""Queries that go through files: the conversations are written in each transcript format and read
back, notes are written and synced again, and a stream counts turns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content as C
from ..operators import messages as M
from ..operators import notes as N
from ..operators import sync as S
from ..operators.running import running_counts
from ..sources import note_files
from ..sources import transcripts as R
from ..sources.shared import drop_at_exit, fresh_folder, local_path, stage
from ..streaming import reminder, sync
from . import catalog, pipelines
from .catalog import messages, query, read


def _folder(spark: SparkSession, label: str) -> str:
    """A folder for files with names of their own; the shared folder must be mounted everywhere."""
    folder = local_path(fresh_folder(spark, label))
    note_files.guard(folder)
    drop_at_exit(spark, f"file://{folder}")
    return folder


def _write(rows: DataFrame, name: Column, text: Column, label: str) -> str:
    folder = _folder(rows.sparkSession, label)
    note_files.put_files(rows.select(name.alias("filename"), text.alias("text")), folder)
    return folder


def _sessions(spark: SparkSession, sf_dir: str, item: Column, upto: int | None = None) -> DataFrame:
    """conv and items: an array of item for the messages of each conversation, in order."""
    rows = messages(spark, sf_dir)
    if upto is not None:
        rows = M.positions(M.spoken(rows)).where(F.col("position") <= upto)
    own = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))).alias("items"))
    return own.select(F.col("session_id").cast("string").alias("conv"), F.transform("items", lambda x: x["item"]).alias("items"))


_SPOKEN = "SELECT conv_id::VARCHAR AS session_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations WHERE role IN ('user', 'assistant')"


def _placed(rows: DataFrame) -> DataFrame:
    return M.positions(rows).select("session_id", "role", "text", (F.col("position") - 1).alias("seq"))


@query(_SPOKEN)
def export_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export files of one conversation each, read back as messages."""
    node = F.struct(F.struct(F.struct(F.col("role")).alias("author"), F.struct(F.array("text").alias("parts")).alias("content"), F.col("seq").cast("double").alias("create_time")).alias("message"))
    rows = _sessions(spark, sf_dir, node)
    mapping = F.map_from_arrays(F.transform("items", lambda _, i: F.concat(F.lit("n"), i.cast("string"))), "items")
    text = F.to_json(F.array(F.struct(F.col("conv").alias("title"), F.lit(1700000000.0).alias("create_time"), mapping.alias("mapping"))))
    conversations = R.export_conversations(spark, _write(rows, F.concat("conv", F.lit(".json")), text, "export"))
    return R.export_messages(conversations, "title").select(F.col("title").alias("session_id"), "role", "text", "seq")


@query(_SPOKEN)
def session_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session documents, read back as messages."""
    rows = _sessions(spark, sf_dir, F.struct("role", F.col("text").alias("content")))
    text = F.to_json(F.struct(F.col("conv").alias("session_id"), F.lit("claude").alias("source"), F.lit("2026-02-10T12:00:00Z").alias("timestamp"), F.col("items").alias("messages")))
    documents = R.session_documents(spark, _write(rows, F.concat("conv", F.lit(".json")), text, "sessions"))
    return _placed(M.spoken(R.session_messages(documents)))


@query(_SPOKEN)
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event logs with malformed lines between, read back as messages."""
    event = F.to_json(F.struct(F.col("role").alias("type"), F.col("session_id").cast("string").alias("sessionId"), F.lit("2026-02-10T12:00:00Z").alias("timestamp"), F.struct("role", F.array("text").alias("content")).alias("message")))
    rows = _sessions(spark, sf_dir, F.concat(event, F.lit("\n{bad json\n[1]\n")))
    documents = R.event_log_documents(spark, _write(rows, F.concat("conv", F.lit(".jsonl")), F.array_join("items", "\n"), "logs"))
    return _placed(R.session_messages(documents))


def _uuid(conv: Column) -> Column:
    return F.concat(F.lpad(conv, 8, "0"), F.lit("-0000-4000-8000-000000000000"))


def _rollout_event() -> Column:
    """The line of a message in a rollout file."""
    said = F.when(F.col("role") == "assistant", "output_text").otherwise("input_text")
    payload = F.struct(F.lit("message").alias("type"), F.col("role"), F.array(F.struct(said.alias("type"), F.col("text"))).alias("content"))
    return F.to_json(F.struct(F.lit("response_item").alias("type"), payload.alias("payload")))


def _rollout_meta(conv: Column) -> Column:
    """The first line of a rollout file."""
    return F.to_json(F.struct(F.lit("session_meta").alias("type"), F.lit("2026-03-01T09:00:01Z").alias("timestamp"), F.struct(_uuid(conv).alias("id")).alias("payload")))


def _rollout_text(spark: SparkSession, sf_dir: str, upto: int | None = None) -> DataFrame:
    """filename and text of a rollout file for each conversation; its last line has no end."""
    rows = _sessions(spark, sf_dir, _rollout_event(), upto)
    return rows.select(F.concat(F.lit("rollout-"), "conv", F.lit(".jsonl")).alias("filename"), F.concat_ws("\n", _rollout_meta(F.col("conv")), F.array_join("items", "\n")).alias("text"))


def _rollouts(spark: SparkSession, sf_dir: str, upto: int | None = None) -> str:
    return _write(_rollout_text(spark, sf_dir, upto), F.col("filename"), F.col("text"), "rollouts")


@query(f"SELECT lpad(session_id, 8, '0') || '-0000-4000-8000-000000000000' AS session_id, role, text, seq FROM ({_SPOKEN})")
def rollout_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollout files, read back as messages of the sessions that their first lines name."""
    events = stage(R.rollout_events(R.rollout_lines(spark, _rollouts(spark, sf_dir))), "rollout-events")
    named = R.rollout_messages(events).join(R.rollout_validated(R.rollout_sessions(events)).where("reason IS NULL").select("path", "session_id"), "path")
    return _placed(named)


_COUNTS = "SELECT lpad(conv_id::VARCHAR, 8, '0') || '-0000-4000-8000-000000000000' AS session_id, count(*) AS msg_count, count(*) FILTER (role = 'user') AS q_count, count(*) FILTER (role = 'assistant') AS a_count FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id"


@query(_COUNTS)
def note_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts of the first four messages are synced to notes, then the grown ones; what the notes say."""
    folder = _folder(spark, "notes")
    pipelines.write(pipelines.plan_rollouts(spark, _rollouts(spark, sf_dir, 4)), folder, sync=False)
    pipelines.write(pipelines.plan_rollouts(spark, _rollouts(spark, sf_dir), R.held_notes(spark, folder)), folder, sync=False)
    return R.notes_snapshot(spark, folder).select("session_id", *(F.col(c).cast("long").alias(c) for c in ("msg_count", "q_count", "a_count")))


@query(
    "SELECT lpad((conv_id % 3)::VARCHAR, 8, '0') AS session, row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id, turn) AS position, "
    "CASE role WHEN 'user' THEN 'Q' ELSE 'A' END || count(*) OVER (PARTITION BY conv_id % 3, role ORDER BY conv_id, turn) AS heading, text "
    "FROM conversations WHERE role IN ('user', 'assistant')"
)
def long_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as three long sessions: rollout files, and notes that are created from the first half and appended to from the
    rest, both written message by message; every message of the notes, read in byte ranges."""
    rows = M.spoken(messages(spark, sf_dir)).withColumn("conv", F.col("session_id")).select(
        "conv", (F.col("conv") % 3).cast("string").alias("session_id"), (F.col("conv") * (1 << 20) + F.col("seq")).alias("seq"), F.concat(_rollout_event(), F.lit("\n")).alias("block"))
    half = (rows.agg(F.max("conv")).first()[0] or 0) // 2
    notes = _folder(spark, "notes")
    for part in (rows.where(F.col("conv") <= half), rows):
        logs = _folder(spark, "rollouts")
        name = F.concat(F.lit("rollout-"), "session_id", F.lit(".jsonl"))
        files = part.select("session_id").distinct().select("session_id", name.alias("filename"), F.concat(_rollout_meta(F.col("session_id")), F.lit("\n")).alias("front"), F.lit(None).alias("expects"), F.lit(None).alias("keep_from"))
        note_files.write_blocks(files, part, logs, sync=False)
        pipelines.write(pipelines.plan_rollouts(spark, logs, R.held_notes(spark, notes)), notes, sync=False)
    is_heading = F.col("line").rlike(r"\A## [QA][0-9]+\z")
    lines = running_counts(stage(R.text_lines(spark, notes, "*.md"), "note-lines"), "file", F.floor(F.col("place") / (1 << 24)), ["place"], {"position": is_heading})
    each = lines.where("position > 0").groupBy("file", "position").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l"))
    text = F.array_join(F.transform(F.slice("l", 2, F.size("l")), lambda x: x["line"]), "\n")
    return each.select(F.regexp_extract("file", r"_([0-9]{8})\.md\z", 1).alias("session"), "position", F.substring(F.col("l")[0]["line"], 4, 20).alias("heading"), F.regexp_replace(text, r"\n\z", "").alias("text"))


@query(f"SELECT *, greatest(least(msg_count, 4) - 1, 0) AS first_lines, msg_count - greatest(least(msg_count, 4) - 1, 0) AS second_lines FROM ({_COUNTS})")
def rollouts_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollout files that grow in place, followed by a stream: the first four messages, of which the last line
    waits for its end, then all. What the notes say, and how many messages each start of the stream has read."""
    logs, notes = _folder(spark, "rollouts"), _folder(spark, "notes")
    table, state = fresh_folder(spark, "rollout-table"), fresh_folder(spark, "rollout-state")
    for path in (table, state):
        drop_at_exit(spark, path)
    ended = F.concat("text", F.lit("\n"))
    for files in (_rollout_text(spark, sf_dir, 4), _rollout_text(spark, sf_dir, 1 << 30).withColumn("text", ended)):
        note_files.write_notes(files.select("filename", F.col("text").alias("markdown")), logs, sync=False)
        sync.follow_rollouts(spark, logs, notes, table, state, sync=False).awaitTermination()
    events = spark.read.schema("path string, said struct<role:string,text:string>, batch long").parquet(f"{table}/events").where("said IS NOT NULL")
    read = events.groupBy(_uuid(F.regexp_extract("path", r"rollout-([^/]*)\.jsonl\z", 1)).alias("session_id")).agg(*(F.count_if(F.col("batch") == n).alias(c) for n, c in enumerate(("first_lines", "second_lines"))))
    held = R.notes_snapshot(spark, notes).select("session_id", *(F.col(c).cast("long").alias(c) for c in ("msg_count", "q_count", "a_count")))
    return held.join(read, "session_id")


_LISTED = "SELECT DISTINCT conv_id::VARCHAR AS session_id, CASE conv_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' END AS source FROM conversations"


@query(f"SELECT * FROM ({_LISTED}) WHERE source IS DISTINCT FROM 'codex'")
def catalogue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogues of at most a hundred sessions each, with and without a source; those of rollouts go."""
    kind = F.col("session_id") % 3
    source = F.when(kind == 0, "claude").when(kind == 1, "codex")
    listed = messages(spark, sf_dir).select("session_id").distinct().select(F.floor(F.col("session_id") / 100).alias("part"), F.struct(F.col("session_id").cast("string").alias("session_id"), source.alias("source")).alias("s"))
    files = listed.groupBy("part").agg(F.to_json(F.struct(F.array_sort(F.collect_list("s")).alias("sessions"))).alias("text"))
    return S.not_from(R.session_catalogue(spark, _write(files, F.concat(F.lit("list-"), F.col("part").cast("string"), F.lit(".json")), F.col("text"), "catalogue")), "codex")


@query(
    "SELECT session_id, conv_id % 2 = 1 AS used_fallback, CASE WHEN conv_id % 2 = 0 THEN 'other' WHEN conv_id % 4 = 1 THEN 'codex' ELSE 'claude' END AS source, "
    "CASE WHEN conv_id % 2 = 0 THEN '2026-02-09T08:00:00Z' WHEN first = 0 THEN '' ELSE '2026-02-10T12:00:' || lpad((first % 60)::VARCHAR, 2, '0') || 'Z' END AS started_at, n AS n_messages "
    "FROM (SELECT conv_id, conv_id::VARCHAR AS session_id, count(*) AS n, coalesce(min(turn) FILTER (turn > 0), 0) AS first FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)"
)
def fallback_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session documents of every other session, event logs of the others: lines without a role of their
    own, times that are missing at first, sources told by the folder. A log of a session's first turn alone has no
    time."""
    said = M.spoken(messages(spark, sf_dir))
    by_session = lambda item: said.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))).alias("items")).select(F.col("session_id").cast("string").alias("conv"), F.transform("items", lambda x: x["item"]).alias("items"))
    document = F.to_json(F.struct(F.lit("other").alias("source"), F.lit("2026-02-09T08:00:00Z").alias("timestamp"), F.col("items").alias("messages")))
    documents = _write(by_session(F.struct("role", F.col("text").alias("content"))).where("conv % 2 = 0"), F.concat("conv", F.lit(".json")), document, "sessions")
    time = F.when(F.col("seq") > 0, F.concat(F.lit("2026-02-10T12:00:"), F.lpad((F.col("seq") % 60).cast("string"), 2, "0"), F.lit("Z"))).otherwise("")
    event = F.to_json(F.struct(F.col("role").alias("type"), F.col("session_id").cast("string").alias("sessionId"), time.alias("timestamp"), F.struct(F.array("text").alias("content")).alias("message")))
    logs = by_session(event).where("conv % 2 = 1")
    base = _folder(spark, "logs")
    for name, rows in ((".codex", logs.where("conv % 4 = 1")), ("projects", logs.where("conv % 4 = 3"))):
        note_files.put_files(rows.select(F.concat("conv", F.lit(".jsonl")).alias("filename"), F.array_join("items", "\n").alias("text")), f"{base}/{name}")
    found = R.with_fallback(R.session_documents(spark, documents), R.event_log_documents(spark, [f"{base}/.codex", f"{base}/projects"]))
    return found.select("session_id", "used_fallback", "source", "started_at", F.size("items").cast("long").alias("n_messages"))


@query(
    "SELECT DISTINCT conv_id::VARCHAR AS session_id, CASE WHEN conv_id % 5 IN (1, 2, 3) THEN 'failed' ELSE 'created' END AS action, "
    "CASE conv_id % 5 WHEN 1 THEN 'missing timestamp or source' WHEN 2 THEN 'missing timestamp or source' WHEN 3 THEN 'bad date' END AS reason FROM conversations "
    "UNION ALL SELECT 'gone', 'failed', 'can''t be read'"
)
def session_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a time, without a source, with a date of another shape; a session that none has."""
    rows, kind = _sessions(spark, sf_dir, F.struct("role", F.col("text").alias("content"))), F.col("conv").cast("long") % 5
    stamp = F.when(kind == 3, "10 Feb 2026").when(kind != 1, "2026-02-10T12:00:00Z")
    text = F.to_json(F.struct(F.when(kind != 2, "claude").alias("source"), stamp.alias("timestamp"), F.col("items").alias("messages")))
    documents = R.session_documents(spark, _write(rows, F.concat("conv", F.lit(".json")), text, "sessions"))
    wanted = rows.select(F.col("conv").alias("session_id")).unionByName(spark.range(1).select(F.lit("gone").alias("session_id")))
    return pipelines.sync_sessions(spark, documents, None, wanted).select("session_id", "action", "reason")


@query(
    "SELECT conv_id::VARCHAR AS session_id, CASE WHEN conv_id % 8 < 4 AND n > 4 THEN 'appended' WHEN conv_id % 8 < 4 THEN 'unchanged' ELSE 'created' END AS action, "
    "CASE WHEN conv_id % 8 >= 4 THEN 'from the event log' END AS reason, n AS to_count "
    "FROM (SELECT conv_id, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id) WHERE conv_id % 4 = 1 "
    "UNION ALL SELECT 'gone', 'failed', 'can''t be read', 0"
)
def hook_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of half of the sessions, of their first four messages, are synced; then they grow, and hook events name a quarter of all
    sessions and one that is gone: the outcome of the run over these, of which half have event logs only."""
    def documents(upto: int | None) -> str:
        rows = _sessions(spark, sf_dir, F.struct("role", F.col("text").alias("content")), upto).where("conv % 8 < 4")
        text = F.to_json(F.struct(F.lit("claude").alias("source"), F.lit("2026-02-10T12:00:00Z").alias("timestamp"), F.col("items").alias("messages")))
        return _write(rows, F.concat("conv", F.lit(".json")), text, "sessions")

    said = M.spoken(messages(spark, sf_dir))
    event = F.to_json(F.struct(F.col("role").alias("type"), F.col("session_id").cast("string").alias("sessionId"), F.lit("2026-02-10T12:00:00Z").alias("timestamp"), F.struct("role", F.array("text").alias("content")).alias("message")))
    logs = _write(_sessions(spark, sf_dir, event), F.concat("conv", F.lit(".jsonl")), F.array_join("items", "\n"), "logs")
    notes = _folder(spark, "notes")
    pipelines.write(pipelines.plan_sessions(spark, R.session_documents(spark, documents(4))), notes, sync=False)
    named = said.select(F.col("session_id").cast("string").alias("session_id")).where("session_id % 4 = 1").unionByName(spark.range(1).select(F.lit("gone").alias("session_id")))
    hooks = fresh_folder(spark, "hook-events")
    drop_at_exit(spark, hooks)
    named.distinct().write.json(hooks)
    wanted = stage(sync.hooked(spark.read.schema("session_id string").json(hooks)), "wanted")
    from_logs = lambda missing, held: R.event_log_documents(spark, logs, wanted=missing, held=held)
    made = pipelines.plan_sessions(spark, R.session_documents(spark, documents(None), wanted), R.held_notes(spark, notes, whole=True), wanted, from_logs)
    return made.rows.select("session_id", "action", "reason", F.col("to_count").cast("long").alias("to_count"))


@query("SELECT 'id-' || session_id AS session_id, msg_count FROM (SELECT conv_id AS session_id, count(*) AS msg_count FROM conversations GROUP BY conv_id)")
def notes_front_matter_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes whose front matter follows other lines, one of them a rule, read back."""
    own = messages(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    head = F.concat(F.lit("written by hand\n\n---\nsession_id: id-"), F.col("session_id").cast("string"), F.lit("\nmsg_count: "), F.col("n").cast("string"), F.lit("\n---\n\n# Title\n"))
    notes = _write(own, F.concat(F.col("session_id").cast("string"), F.lit(".md")), head, "notes")
    return R.notes_snapshot(spark, notes, anywhere=True).select("session_id", F.col("msg_count").cast("long").alias("msg_count"))


_OPEN = "CASE turn % 5 WHEN 1 THEN '```' || chr(10) || '## Q7' || chr(10) || text ELSE text END"
_SAID = f"SELECT 'same-id-' || conv_id AS session_id, turn AS seq, CASE conv_id % 10 WHEN 0 THEN 'system' ELSE role END AS role, {_OPEN} AS t FROM conversations"
_PLACED = f"SELECT *, count(*) FILTER (role IN ('user', 'assistant')) OVER (PARTITION BY session_id ORDER BY seq) AS position FROM ({_SAID})"
_FIRST = f"SELECT * FROM ({_PLACED}) WHERE role NOT IN ('user', 'assistant') OR position <= 4"
_NUMBERS = f"SELECT *, count(*) OVER (PARTITION BY session_id, role ORDER BY seq) AS n FROM ({_PLACED}) WHERE role IN ('user', 'assistant')"
_BODIES = f"SELECT session_id, count(*) AS msg_count, string_agg('## ' || CASE role WHEN 'user' THEN 'Q' ELSE 'A' END || n || chr(10) || t || chr(10) || chr(10), '' ORDER BY seq) AS body FROM ({_NUMBERS}) GROUP BY session_id"


@query(
    f"WITH s AS (SELECT session_id, title, coalesce(body, '') AS body, coalesce(msg_count, 0) AS msg_count FROM ({catalog._titles(catalog._titled(_FIRST))}) LEFT JOIN ({_BODIES}) USING (session_id)), "
    f"b AS (SELECT *, '2026-02-10_' || ({catalog._name('title', 'session')}) || '_same-id-' AS base FROM s), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY session_id) - 1 AS nth FROM b) "
    "SELECT session_id, base || CASE WHEN nth > 0 THEN '_' || nth ELSE '' END || '.md' AS filename, "
    f"{catalog._HEAD} || 'source: \"Claude Code\"' || chr(10) || 'session_id: \"' || session_id || '\"' || chr(10) || 'tags:' || chr(10) || '  - \"claude\"' || chr(10) || {catalog._TAIL} AS markdown, "
    "'created' AS first, CASE WHEN msg_count > 4 THEN 'appended' ELSE 'unchanged' END AS second, 'unchanged' AS third FROM f"
)
def session_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of their first four messages, then of all, then again: the outcome of each run and the
    notes. Code that is never closed, headings inside messages, ids that begin alike, sessions of system
    messages only."""
    kind = F.col("seq") % 5
    said = messages(spark, sf_dir).select(
        F.concat(F.lit("same-id-"), F.col("session_id").cast("string")).alias("session_id"), "seq",
        F.when(F.col("session_id") % 10 == 0, "system").otherwise(F.col("role")).alias("role"), F.when(kind == 1, F.concat(F.lit("```\n## Q7\n"), "text")).otherwise(F.col("text")).alias("text"),
    )
    spoken = F.col("role").isin(*M.ROLES)
    position = F.count_if(spoken).over(M.by_session())
    placed = said.withColumn("early", ~spoken | (position <= 4))
    notes, outcomes = _folder(spark, "notes"), []
    for rows in (placed.where("early"), placed, placed):
        own = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", F.col("text").alias("content")))).alias("messages"))
        text = F.to_json(F.struct(F.lit("claude").alias("source"), F.lit("2026-02-10T12:00:00Z").alias("timestamp"), F.col("messages")))
        documents = R.session_documents(spark, _write(own, F.concat("session_id", F.lit(".json")), text, "sessions"))
        made = pipelines.plan_sessions(spark, documents, R.held_notes(spark, notes, whole=True))
        made = replace(made, rows=stage(made.rows, "outcomes"))
        pipelines.write(made, notes, sync=False)
        outcomes.append(made.rows.select("session_id", F.col("action").alias(("first", "second", "third")[len(outcomes)])))
    held = R.notes_snapshot(spark, notes).select("session_id", "filename", "markdown")
    return held.join(outcomes[0], "session_id").join(outcomes[1], "session_id").join(outcomes[2], "session_id")


@query(
    f"WITH s AS (SELECT session_id, 'Talk: ' || (session_id % 7) AS title, body FROM ({catalog._BODY})), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY session_id) - 1 AS nth FROM s) "
    "SELECT '2026-02-10_Talk_' || (session_id % 7) || CASE WHEN nth > 0 THEN '_' || nth ELSE '' END || '.md' AS filename, "
    f"rtrim({catalog._HEAD} || 'source: ChatGPT' || chr(10) || 'tags: [chatgpt]' || chr(10) || {catalog._TAIL}, chr(10)) || chr(10) AS markdown FROM f"
)
def export_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export files of at most fifty conversations with titles that repeat; all notes are written, twice."""
    node = F.struct(F.struct(F.struct(F.col("role")).alias("author"), F.struct(F.array("text").alias("parts")).alias("content"), F.col("seq").cast("double").alias("create_time")).alias("message"))
    rows = _sessions(spark, sf_dir, node).withColumn("conv", F.col("conv").cast("long"))
    mapping = F.map_from_arrays(F.transform("items", lambda _, i: F.concat(F.lit("n"), i.cast("string"))), "items")
    title = F.concat(F.lit("Talk: "), (F.col("conv") % 7).cast("string"))
    one = rows.select(F.floor(F.col("conv") / 50).alias("part"), "conv", F.struct(title.alias("title"), F.lit(1770724800.0).alias("create_time"), mapping.alias("mapping")).alias("c"))
    files = one.groupBy("part").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("conv", F.to_json("c").alias("c")))), lambda x: F.parse_json(x["c"]))).alias("text"))
    export, notes = _write(files, F.concat(F.lit("export-"), F.lpad(F.col("part").cast("string"), 9, "0"), F.lit(".json")), F.col("text"), "export"), _folder(spark, "notes")
    for _ in range(2):
        pipelines.write(pipelines.export_notes(spark, export), notes, sync=False)
    return R.notes_snapshot(spark, notes).select("filename", "markdown")


_ROLLED = catalog._titles(catalog._titled(f"SELECT lpad(session_id, 8, '0') AS session_id, seq, role, text AS t FROM ({_SPOKEN})"))


@query(f"SELECT session_id || '-0000-4000-8000-000000000000' AS session_id, '2026-03-01_' || ({catalog._name('title', 'rollout')}) || '_' || session_id || '.md' AS filename, 'created' AS action FROM ({_ROLLED})")
def index_and_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over rollout files leaves in its index of notes and in its log."""
    sinks = {name: fresh_folder(spark, name) for name in ("index", "log")}
    for path in sinks.values():
        drop_at_exit(spark, path)
    pipelines.write(pipelines.plan_rollouts(spark, _rollouts(spark, sf_dir)), _folder(spark, "notes"), sync=False, **sinks)
    logged = spark.read.schema("session_id string, action string").json(sinks["log"])
    return R.read_index(spark, sinks["index"]).join(logged, "session_id")


@query("SELECT action, count(*) AS sessions FROM (SELECT CASE WHEN count(*) > 4 THEN 'appended' ELSE 'unchanged' END AS action FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id) GROUP BY action")
def sync_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes of the second of those two runs."""
    folder = _folder(spark, "notes")
    pipelines.write(pipelines.plan_rollouts(spark, _rollouts(spark, sf_dir, 4)), folder, sync=False)
    return pipelines.write(pipelines.plan_rollouts(spark, _rollouts(spark, sf_dir), R.held_notes(spark, folder)), folder, sync=False)


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content: by turn a string, a mixed list, null, a number or an object."""
    text = F.to_json(F.struct(F.col("text").alias("t")))
    quoted = F.substring(text, 6, F.length(text) - 6)
    item = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    mixed = item('["a",{"type":"text","text":', quoted, '},{"type":"tool_use"},{"type":"output_text","text":', quoted, '},5,{"type":"input_text"}]')
    kind = F.col("seq") % 5
    raw = F.when(kind == 0, quoted).when(kind == 1, mixed).when(kind == 2, "null").when(kind == 3, "12").otherwise(item('{"type":"text","text":', quoted, "}"))
    return messages(spark, sf_dir).select("session_id", "seq", F.parse_json(raw).alias("content"))


def _flat(event: str, body: str, rollout: str, title: str) -> str:
    return f"SELECT conv_id AS session_id, turn AS seq, {event} AS event, {body} AS body, {rollout} AS rollout, {title} AS title FROM conversations"


_NL = " || chr(10) || "


@query(
    _flat(
        f"CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN 'a'{_NL}text ELSE '' END",
        f"CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN 'a'{_NL}text || chr(10) || chr(10) || chr(10) || chr(10) WHEN 2 THEN 'None' WHEN 3 THEN '12' ELSE '{{\"text\":' || to_json(text)::VARCHAR || ',\"type\":\"text\"}}' END",
        f"CASE turn % 5 WHEN 1 THEN text || chr(10) ELSE '' END",
        f"CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN 'a'{_NL}text{_NL}text END",
    )
)
def content_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four ways to flatten a content of mixed types."""
    c = F.col("content")
    return _mixed(spark, sf_dir).select("session_id", "seq", C.flatten_event(c).alias("event"), C.flatten_body(c).alias("body"), C.flatten_rollout(c).alias("rollout"), C.flatten_title(c).alias("title"))


@query(f"SELECT conv_id AS session_id, turn AS seq, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text{_NL}'' END AS text FROM conversations")
def content_flatten_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an export: strings stay, images go, a message without strings is null."""
    kind, quoted = F.col("seq") % 3, F.to_json(F.struct(F.col("text").alias("t")))
    own = F.substring(quoted, 6, F.length(quoted) - 6)
    raw = F.when(kind == 0, F.concat(F.lit("["), own, F.lit(',{"image":1}]'))).when(kind == 1, F.concat(F.lit("["), own, F.lit(',""]'))).otherwise('[{"image":1}]')
    return messages(spark, sf_dir).select("session_id", "seq", C.flatten_export(F.from_json(raw, "array<variant>")).alias("text"))


def _reminders(spark: SparkSession, sf_dir: str, counters: DataFrame | None = None) -> DataFrame:
    """The turn counter as a stream over the events; some have no id, or none that can be a key."""
    path = f"{sf_dir}/events.parquet"
    hooks = fresh_folder(spark, "hook-events")  # a stream reads a folder
    kind = F.when(F.col("event_id") % 22 == 0, "//").when(F.col("event_id") % 11 == 0, "").otherwise(F.col("user_id").cast("string"))
    spark.read.parquet(path).select(kind.alias("session_id")).write.json(hooks)
    drop_at_exit(spark, hooks)
    events = spark.readStream.schema("session_id string").json(hooks)
    state, output = fresh_folder(spark, "reminder-state"), fresh_folder(spark, "reminders")
    for path in (state, output):
        drop_at_exit(spark, path)
    return reminder.run_available(spark, events, state, output, counters).select("session_id", "turn")


_TURNS = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events WHERE event_id % 11 <> 0"


@query(f"SELECT user_id::VARCHAR AS session_id, turn FROM ({_TURNS}) WHERE turn % 20 = 0")
def reminder_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reminders(spark, sf_dir)


@query(f"SELECT user_id::VARCHAR AS session_id, turn + CASE user_id % 4 WHEN 0 THEN 19 WHEN 1 THEN 1000000 ELSE 0 END AS turn FROM ({_TURNS}) WHERE (turn + CASE user_id % 4 WHEN 0 THEN 19 ELSE 0 END) % 20 = 0")
def reminder_taken_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from counters that users had before, of which some are no numbers, some missing, some there twice."""
    user = F.col("user_id") % 4
    value = F.when(user == 0, "19").when(user == 1, "1000000").otherwise("-7")
    held = read(spark, sf_dir, "events").select("user_id").distinct().where(user < 3).select(F.concat(F.lit("/"), F.col("user_id").cast("string")).alias("session_id"), value.alias("value"))
    return _reminders(spark, sf_dir, held.unionByName(held.withColumn("value", F.lit("3x"))))


@query(f"SELECT session_id, markdown FROM ({catalog._NOTE_SQL['rollout']})")
def note_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes whose msg_count is one too low get it replaced in their text."""
    rows = catalog._noted(spark, sf_dir)
    low = rows.withColumn("msg_count", F.col("msg_count") - 1).select("session_id", N.markdown(N.ROLLOUT).alias("note"))
    return low.join(rows.select("session_id", "msg_count"), "session_id").select("session_id", N.with_msg_count(F.col("note"), F.col("msg_count")).alias("markdown"))


_UNITED = " UNION ALL ".join(f"SELECT '{name}' AS source, session_id, seq, role, text FROM ({sql})" for name, sql in (("export", _SPOKEN), ("session", _SPOKEN), ("rollout", f"SELECT lpad(session_id, 8, '0') || '-0000-4000-8000-000000000000' AS session_id, role, text, seq FROM ({_SPOKEN})")))


@query(_UNITED)
def message_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three formats in one frame of canonical messages."""
    return M.united(export=export_scan(spark, sf_dir), session=session_scan(spark, sf_dir), rollout=rollout_scan(spark, sf_dir))
