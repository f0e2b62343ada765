"""The registered queries over the driver's tables, with their DuckDB equivalents.

The tables have no tags, fences or characters that file names can't hold, so most queries first
decorate whole texts, by a rule that the SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import messages as M
from ..operators import notes as N
from ..operators import sync as S
from ..operators.running import block_of, running_counts
from ..sources.shared import spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Pieces of SQL that several oracles share.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _escape(x: str) -> str:
    """yaml_escape of x, for characters of the basic plane."""
    return (
        f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE c WHEN '\"' THEN '\\\"' WHEN '\\' THEN '\\\\' WHEN chr(10) THEN '\\n' WHEN chr(13) THEN '\\r' "
        "WHEN chr(9) THEN '\\t' WHEN chr(8) THEN '\\b' WHEN chr(12) THEN '\\f' ELSE CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN c ELSE printf('\\u%04x', unicode(c)) END END), '')"
    )


def _clean(x: str, kind: str) -> str:
    """The sanitised name of x, before it is cut and stripped of dots."""
    bare = rf"""regexp_replace({x}, '[<>:"/\\|?*]|[\x00-\x1f\x7f]', '', 'g')"""
    if kind == "export":
        return f"regexp_replace({bare}, '{_WS}+', '_', 'g')"
    spaced = f"regexp_replace({bare}, '{_WS}+', '_', 'g')" if kind == "session" else f"replace({bare}, ' ', '_')"
    return f"regexp_replace({spaced}, '_+', '_', 'g')"


def _name(x: str, kind: str) -> str:
    clean = _clean(x, kind)
    done = rf"trim(substr({clean}, 1, 50), '.')" if kind == "export" else rf"substr(trim({clean}, '.'), 1, 50)"
    return f"CASE WHEN {done} IN ('', '.', '..') THEN 'untitled' ELSE {done} END"


_MESSAGES = "SELECT conv_id AS session_id, turn AS seq, role, text FROM conversations"
_SPOKEN = f"SELECT * FROM ({_MESSAGES}) WHERE role IN ('user', 'assistant')"
_NUMBERED = (
    "SELECT session_id, seq, role, text, row_number() OVER w AS position, (CASE role WHEN 'user' THEN sum(CASE role WHEN 'user' THEN 1 ELSE 0 END) OVER w "
    f"ELSE sum(CASE role WHEN 'assistant' THEN 1 ELSE 0 END) OVER w END)::BIGINT AS n FROM ({_SPOKEN}) WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"
)
_BLOCK = "'## ' || CASE role WHEN 'user' THEN 'Q' ELSE 'A' END || n || chr(10) || text || chr(10) || chr(10)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as canonical messages."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", "text")


@query(f"SELECT session_id, string_agg({_BLOCK}, '' ORDER BY seq) AS body, count(*) AS msg_count, count(*) FILTER (role = 'user') AS q_count, count(*) FILTER (role = 'assistant') AS a_count FROM ({_NUMBERED}) GROUP BY session_id")
def note_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: filter, number and render the messages of each session; one shuffle."""
    return M.rendered(M.numbered(M.spoken(messages(spark, sf_dir))))


@query(f"SELECT session_id, count(*) AS all_count, count(*) FILTER (role IN ('user', 'assistant')) AS qa_count FROM ({_MESSAGES}) GROUP BY session_id")
def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.counts(messages(spark, sf_dir))


@query(f"SELECT session_id, seq, role, position, n FROM ({_NUMBERED})")
def qa_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.numbered(M.positions(M.spoken(messages(spark, sf_dir)))).select("session_id", "seq", "role", "position", "n")


def existing(spark: SparkSession, sf_dir: str, upto: int = 4) -> DataFrame:
    """Notes as an earlier run left them, when each session had at most ``upto`` messages."""
    early = M.numbered(M.positions(M.spoken(messages(spark, sf_dir))).where(F.col("position") <= upto))
    return M.rendered(early).select("session_id", "msg_count", "q_count", "a_count", F.concat(F.col("session_id").cast("string"), F.lit(".md")).alias("filename"), F.col("body").alias("markdown"))


@query(f"SELECT session_id, seq, role, n, text FROM ({_NUMBERED}) WHERE position > 4")
def append_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is new since the first four messages of every session, numbered on from them."""
    spoken = M.spoken(messages(spark, sf_dir))
    dispatched = S.dispatch(spoken.groupBy("session_id").agg(F.count(F.lit(1)).alias("msg_count")), existing(spark, sf_dir))
    return S.new_messages(spoken, dispatched).select("session_id", "seq", "role", "n", "text")


_ACTIONS = """SELECT session_id, now AS msg_count, CASE WHEN now = 0 THEN 'skipped' WHEN session_id % 4 = 0 THEN 'created' WHEN session_id % 4 = 3 THEN 'skipped'
 WHEN now <= CASE session_id % 4 WHEN 1 THEN now ELSE now - 1 END THEN 'unchanged' ELSE 'appended' END AS action
 FROM (SELECT session_id, count(*) FILTER (role IN ('user', 'assistant')) AS now FROM (SELECT conv_id AS session_id, role FROM conversations) GROUP BY session_id)"""


def _acted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions against notes that are missing, equal, one message short or damaged, by session."""
    sessions = M.counts(messages(spark, sf_dir)).select("session_id", F.col("qa_count").alias("msg_count"))
    state = F.col("session_id") % 4
    held = sessions.where(state != 0).select("session_id", F.when(state == 1, F.col("msg_count")).when(state == 2, F.col("msg_count") - 1).alias("msg_count"))
    notes = held.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("q_count", "long"), ("a_count", "long"), ("filename", "string"), ("markdown", "string"))))
    return S.dispatch(sessions, notes).select("session_id", "msg_count", "action")


@query(_ACTIONS)
def sync_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _acted(spark, sf_dir)


@query(f"SELECT action, count(*) AS sessions FROM ({_ACTIONS}) GROUP BY action")
def sync_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.outcomes(_acted(spark, sf_dir))


def _decorated() -> Column:
    kind = F.col("seq") % 5
    return (
        F.when(kind == 0, F.col("text"))
        .when(kind == 1, F.concat(F.lit('<ctx a="1">secret\nstuff</ctx> <br/> '), F.col("text")))
        .when(kind == 2, F.concat(F.lit("##  "), F.col("text")))
        .when(kind == 3, F.concat(F.lit("---\ntitle: x\n"), F.col("text")))
        .otherwise(F.concat(F.lit("Implement the following plan: a\n　ok\n"), F.col("text")))
    )


_DECORATED = (
    "CASE seq % 5 WHEN 0 THEN text WHEN 1 THEN '<ctx a=\"1\">secret' || chr(10) || 'stuff</ctx> <br/> ' || text WHEN 2 THEN '##  ' || text "
    "WHEN 3 THEN '---' || chr(10) || 'title: x' || chr(10) || text ELSE 'Implement the following plan: a' || chr(10) || chr(12288) || 'ok' || chr(10) || text END"
)
def _bare(x: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace({_strip(x)}, '(?s)<ctx(?:\s[^>]*)?>.*?</ctx>', '', 'g'), '<[^>]+?>', '', 'g')")


_BARE = _bare("t")
_STARTS = "^(" + "|".join(s.replace("\n", "\\n") for s in T.SYSTEM_STARTS).replace(".", r"\.") + ")"
_TOLD = f"list_filter(list_transform(string_split(b, chr(10)), lambda x: {_strip('x')}), lambda x: NOT regexp_matches(lower(x), '^({'|'.join(T.BOILERPLATE_STARTS)})') AND x NOT IN ('', '---', '#'))"
_TITLE = f"CASE WHEN NOT regexp_matches(lower(b), '{_STARTS}') THEN substr(list_filter(list_transform({_TOLD}, lambda x: regexp_replace(x, '^#+{_WS}*', '')), lambda x: length(x) >= 5)[1], 1, 50) END"
def _titled(rows: str) -> str:
    """session_id, seq, role and what each message of rows (with its text as t) gives as a title."""
    return f"SELECT session_id, seq, role, {_TITLE} AS title FROM (SELECT *, {_BARE} AS b FROM ({rows}))"


def _titles(titled: str) -> str:
    return f"SELECT session_id, coalesce(arg_min(title, seq) FILTER (role = 'user' AND title IS NOT NULL), arg_min(title, seq) FILTER (role = 'assistant' AND title IS NOT NULL), 'untitled') AS title FROM ({titled}) GROUP BY session_id"


_TITLED = _titled(f"SELECT session_id, seq, role, {_DECORATED} AS t FROM ({_SPOKEN})")
_TITLES = _titles(_TITLED)


@query(_TITLED)
def message_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.spoken(messages(spark, sf_dir)).select("session_id", "seq", "role", T.title_of(_decorated()).alias("title"))


@query(_TITLES)
def session_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.titles(M.spoken(messages(spark, sf_dir)), _decorated())


@query(f"SELECT session_id, seq, {_BARE} AS bare FROM (SELECT session_id, seq, {_DECORATED} AS t FROM ({_MESSAGES}))")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("session_id", "seq", T.strip_tags(T.strip(_decorated())).alias("bare"))


@query()
def strip_tags_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("bare"))


_CONTEXT = r"'^(# AGENTS\.md|<INSTRUCTIONS>|<environment_context>|<uploaded_file)'"


@query(
    f"SELECT session_id, seq, role, t AS text FROM (SELECT session_id, seq, role, CASE seq % 4 WHEN 0 THEN ' <environment_context>' || text WHEN 1 THEN chr(12288) || ' ' WHEN 2 THEN '# agents.md' || text ELSE text END AS t FROM ({_MESSAGES})) "
    rf"WHERE NOT (role = 'user' AND regexp_matches(regexp_replace(t, '^{_WS}+', ''), {_CONTEXT})) AND regexp_matches(t, '[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]')"
)
def context_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of the system and blank messages go."""
    kind = F.col("seq") % 4
    text = F.when(kind == 0, F.concat(F.lit(" <environment_context>"), F.col("text"))).when(kind == 1, "　 ").when(kind == 2, F.concat(F.lit("# agents.md"), F.col("text"))).otherwise(F.col("text"))
    return M.without_blank(M.without_context(messages(spark, sf_dir).withColumn("text", text)))


def _titled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.array(*(F.lit(x) for x in ('a/b: "', "..　  ", "<x>|?*\t.", "a  b__c")))
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.concat(F.get(mark, (F.col("doc_id") % 4).cast("int")), F.coalesce("text", F.lit(""))).alias("title"))


_DOCUMENTS = "SELECT doc_id, ['a/b: \"', '..' || chr(12288) || '  ', '<x>|?*' || chr(9) || '.', 'a  b__c'][doc_id % 4 + 1] || coalesce(text, '') AS title FROM documents"


@query(f"SELECT doc_id, {_name('title', 'export')} AS name FROM ({_DOCUMENTS})")
def sanitize_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled_documents(spark, sf_dir).select("doc_id", T.sanitize_export(F.col("title")).alias("name"))


@query(f"SELECT doc_id, {_name('title', 'session')} AS name FROM ({_DOCUMENTS})")
def sanitize_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled_documents(spark, sf_dir).select("doc_id", T.sanitize_session(F.col("title")).alias("name"))


@query(f"SELECT doc_id, {_name('title', 'rollout')} AS name FROM ({_DOCUMENTS})")
def sanitize_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled_documents(spark, sf_dir).select("doc_id", T.sanitize_rollout(F.col("title")).alias("name"))


@query(f"SELECT doc_id, {_escape('title')} AS escaped FROM ({_DOCUMENTS})")
def yaml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled_documents(spark, sf_dir).select("doc_id", T.yaml_escape(F.col("title")).alias("escaped"))


@query(f"SELECT doc_id, replace(replace(title, chr(10), ' '), chr(13), '') AS export_heading, replace(replace(title, chr(10), ''), chr(13), '') AS heading, {_strip('title')} AS stripped, substr(regexp_replace(title, '[^A-Za-z0-9_-]', '', 'g'), 1, 64) AS state_key FROM ({_DOCUMENTS})")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.col("title")
    return _titled_documents(spark, sf_dir).select("doc_id", T.heading_export(title).alias("export_heading"), T.heading(title).alias("heading"), T.strip(title).alias("stripped"), T.state_key(title).alias("state_key"))


_SHORT = "coalesce(nullif(substr(regexp_replace(sid, '[^A-Za-z0-9_-]', '', 'g'), 1, 8), ''), substr(sha256(sid), 1, 8))"


@query(f"SELECT doc_id, '2026-02-10_' || ({_name('title', 'session')}) || '_' || {_SHORT} AS session_name, '2026-02-10_' || ({_name('title', 'rollout')}) || '_' || substr(sid, 1, 8) AS rollout_name, '2026-02-10_' || ({_name('title', 'export')}) AS export_name FROM (SELECT doc_id, title, CASE doc_id % 3 WHEN 0 THEN '日本' || chr(12288) WHEN 1 THEN 'a/b/c-' || doc_id ELSE 'session-' || doc_id END AS sid FROM ({_DOCUMENTS}))")
def note_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 3
    rows = _titled_documents(spark, sf_dir).withColumn(
        "session_id", F.when(kind == 0, "日本　").when(kind == 1, F.concat(F.lit("a/b/c-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("session-"), F.col("doc_id").cast("string")))
    ).withColumn("date", F.lit("2026-02-10"))
    return rows.select("doc_id", *(N.base_name(d).alias(f"{d.name}_name") for d in (N.SESSION, N.ROLLOUT, N.EXPORT)))


@query("SELECT doc_id, base || CASE WHEN nth > 0 THEN '_' || nth ELSE '' END || '.md' AS filename FROM (SELECT doc_id, base, row_number() OVER (PARTITION BY base ORDER BY doc_id) - 1 AS nth FROM (SELECT doc_id, coalesce(lang, '-') || '_' || coalesce(source, '-') AS base FROM documents))")
def filename_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat_ws("_", F.coalesce("lang", F.lit("-")), F.coalesce("source", F.lit("-")))
    return N.numbered_names(read(spark, sf_dir, "documents").select("doc_id", base.alias("base")), "base", ["doc_id"], block_of("doc_id")).select("doc_id", "filename")


@query(
    "WITH b AS (SELECT doc_id, 'x_' || coalesce(lang, '-') AS base, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS nth FROM documents), "
    "t AS (SELECT DISTINCT 'x_' || coalesce(lang, '-') AS base, length(coalesce(lang, '-')) AS k FROM documents), "
    "used AS (SELECT base, 0 AS slot FROM t UNION ALL SELECT base, 2 FROM t UNION ALL SELECT base, 3 FROM t), "
    "free AS (SELECT base, i AS slot, row_number() OVER (PARTITION BY base ORDER BY i) - 1 AS nth FROM t, range(0, (SELECT count(*) + 4 FROM documents)) r(i) WHERE (base, i) NOT IN (SELECT base, slot FROM used)) "
    "SELECT doc_id, b.base || CASE WHEN slot > 0 THEN '_' || slot ELSE '' END || '.md' AS filename FROM b JOIN free USING (base, nth)"
)
def free_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New notes in a folder where base.md, base_2.md and base_3.md are taken."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("x_"), F.coalesce("lang", F.lit("-"))).alias("base"))
    taken = rows.select("base").distinct().select(F.explode(F.transform(F.array(F.lit(""), F.lit("_2"), F.lit("_3")), lambda s: F.concat("base", s, F.lit(".md")))).alias("filename"))
    return N.free_names(rows, "base", taken, ["doc_id"], block_of("doc_id")).select("doc_id", "filename")


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with all that front matter needs."""
    spoken = M.spoken(messages(spark, sf_dir))
    body = M.rendered(M.numbered(spoken))
    joined = body.join(M.titles(spoken, _decorated()), "session_id")
    source = F.get(F.array(F.lit("claude"), F.lit("codex"), F.lit('ot"her')), (F.col("session_id") % 3).cast("int"))
    return joined.select(F.concat(F.lit("s-é-"), F.col("session_id").cast("string")).alias("session_id"), source.alias("source"), F.lit("2026-02-10").alias("date"), "title", "body", "msg_count", "q_count", "a_count")


_BODY = f"SELECT session_id, string_agg({_BLOCK}, '' ORDER BY seq) AS body, count(*) AS msg_count FROM ({_NUMBERED}) GROUP BY session_id"
_NOTED = f"SELECT 's-é-' || session_id AS session_id, ['claude', 'codex', 'ot\"her'][session_id % 3 + 1] AS source, title, body, msg_count FROM ({_TITLES}) JOIN ({_BODY}) USING (session_id)"
_HEAD = "'---' || chr(10) || 'date: 2026-02-10' || chr(10) || 'title: \"' || " + _escape("title") + " || '\"' || chr(10)"
_TAIL = "'---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || body"
_LABEL = "CASE source WHEN 'claude' THEN 'Claude Code' WHEN 'codex' THEN 'Codex' ELSE source END"
_NOTE_SQL = {
    "export": f"SELECT session_id, rtrim({_HEAD} || 'source: ChatGPT' || chr(10) || 'tags: [chatgpt]' || chr(10) || {_TAIL}, chr(10)) || chr(10) AS markdown FROM ({_NOTED})",
    "session": f"SELECT session_id, {_HEAD} || 'source: \"' || {_escape(_LABEL)} || '\"' || chr(10) || 'session_id: \"' || {_escape('session_id')} || '\"' || chr(10) || 'tags:' || chr(10) || '  - \"' || {_escape('source')} || '\"' || chr(10) || {_TAIL} AS markdown FROM ({_NOTED})",
    "rollout": f"SELECT session_id, {_HEAD} || 'source: Codex' || chr(10) || 'session_id: ' || session_id || chr(10) || 'msg_count: ' || msg_count || chr(10) || 'tags:' || chr(10) || '  - codex' || chr(10) || {_TAIL} AS markdown FROM ({_NOTED})",
}


@query(_NOTE_SQL["export"])
def note_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noted(spark, sf_dir).select("session_id", N.markdown(N.EXPORT).alias("markdown"))


@query(_NOTE_SQL["session"])
def note_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noted(spark, sf_dir).select("session_id", N.markdown(N.SESSION).alias("markdown"))


@query(_NOTE_SQL["rollout"])
def note_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noted(spark, sf_dir).select("session_id", N.markdown(N.ROLLOUT).alias("markdown"))


@query(f"SELECT session_id, session_id AS stored_id, msg_count FROM ({_NOTED})")
def front_matter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write notes in one dialect, read the id and the high-water mark back from their text."""
    note = N.markdown(N.ROLLOUT)
    return _noted(spark, sf_dir).select("session_id", N.stored_session_id(note).alias("stored_id"), N.stored_msg_count(note).cast("long").alias("msg_count"))


_FENCED = "'## Q1' || chr(10) || 'x' || chr(10) || '```' || chr(10) || '## Q2' || chr(10) || '```' || chr(10) || coalesce(text, '') || chr(10) || '## A' || doc_id || chr(10) || '## A2 extra'"


def _fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat(F.lit("## Q1\nx\n```\n## Q2\n```\n"), F.coalesce("text", F.lit("")), F.lit("\n## A"), F.col("doc_id").cast("string"), F.lit("\n## A2 extra"))
    return read(spark, sf_dir, "documents").select("doc_id", note.alias("note"))


@query(f"SELECT doc_id, len(list_filter(string_split({_FENCED}, chr(10)), lambda x: regexp_matches(x, '^## [QA][0-9]+'))) AS headings FROM documents")
def heading_count_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fenced(spark, sf_dir).select("doc_id", N.heading_count(F.col("note")).cast("long").alias("headings"))


@query(
    f"WITH l AS (SELECT doc_id, unnest(string_split({_FENCED}, chr(10))) AS line, generate_subscripts(string_split({_FENCED}, chr(10)), 1) AS i FROM documents), "
    "f AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) % 2 = 1 AS code FROM l) "
    r"SELECT doc_id, count(*) FILTER (NOT code AND regexp_matches(line, '^## Q\d+$')) AS q_count, count(*) FILTER (NOT code AND regexp_matches(line, '^## A\d+$')) AS a_count FROM f GROUP BY doc_id"
)
def heading_count_fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.fenced_heading_counts(F.col("note"))
    return _fenced(spark, sf_dir).select("doc_id", found["q"].cast("long").alias("q_count"), found["a"].cast("long").alias("a_count"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events")
def date_from_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's timestamps have no zone and are taken as UTC; so is the date."""
    ts, kind = F.col("ts").cast("timestamp_ntz"), F.col("event_id") % 5
    seconds = F.unix_date(F.to_date(ts)) * 86400.0 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return read(spark, sf_dir, "events").select("event_id", T.date_from_epoch(F.when(kind == 0, F.when(F.col("event_id") % 2 == 0, 0.0)).otherwise(seconds), utc=True).alias("day"))


_STAMP = "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') || 'T23:59:59+09:00' WHEN 1 THEN '2026-02-30T00:00:00Z' WHEN 2 THEN '2026-2-3' ELSE '' END"


@query(
    rf"SELECT event_id, day, regexp_full_match(day, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS shaped, regexp_full_match(day, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(day AS DATE) IS NOT NULL AS valid FROM (SELECT event_id, split_part({_STAMP}, 'T', 1) AS day FROM events)"
)
def date_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 4
    stamp = F.when(kind == 0, F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd"), F.lit("T23:59:59+09:00"))).when(kind == 1, "2026-02-30T00:00:00Z").when(kind == 2, "2026-2-3").otherwise("")
    day = T.date_prefix(stamp)
    return read(spark, sf_dir, "events").select("event_id", day.alias("day"), T.has_date_shape(day).alias("shaped"), T.is_date(day).alias("valid"))


_UUID = "lpad(to_hex(event_id), 8, '0') || CASE event_id % 3 WHEN 0 THEN '-0000-4000-8000-' WHEN 1 THEN '-0000-4000-80G0-' ELSE '-0000-4000-8000_' END || lpad(to_hex(event_id * 977), 12, '0')"


@query(rf"SELECT event_id, regexp_full_match({_UUID}, '[0-9a-fA-F]{{8}}-([0-9a-fA-F]{{4}}-){{3}}[0-9a-fA-F]{{12}}') AS valid FROM events")
def valid_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 3
    middle = F.when(kind == 0, "-0000-4000-8000-").when(kind == 1, "-0000-4000-80G0-").otherwise("-0000-4000-8000_")
    text = F.concat(F.lpad(F.hex("event_id"), 8, "0"), middle, F.lpad(F.hex(F.col("event_id") * 977), 12, "0"))
    return read(spark, sf_dir, "events").select("event_id", T.is_uuid(text).alias("valid"))


@query(r"SELECT event_id, CASE WHEN regexp_full_match(t, '[0-9]+') THEN coalesce(try_cast(t AS BIGINT), 0) ELSE 0 END AS counter FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN '-' || event_id WHEN 2 THEN ' 7' ELSE '' END AS t FROM events)")
def stored_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, own = F.col("event_id") % 4, F.col("event_id").cast("string")
    text = F.when(kind == 0, own).when(kind == 1, F.concat(F.lit("-"), own)).when(kind == 2, " 7").otherwise("")
    return read(spark, sf_dir, "events").select("event_id", T.counter_value(text).alias("counter"))


_LINE = "CASE event_id % 4 WHEN 0 THEN '{bad json' WHEN 1 THEN '{\"type\":null,\"n\":' || event_id || '}' WHEN 2 THEN '{\"type\":\"' || event_type || '\"}' ELSE '' END"


@query(f"SELECT event_id, coalesce(CASE WHEN json_valid({_LINE}) THEN ({_LINE})::JSON ->> '$.type' END, '') AS kind FROM events WHERE json_valid({_LINE})")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no JSON go; null and missing fields are empty."""
    kind = F.col("event_id") % 4
    line = F.when(kind == 0, "{bad json").when(kind == 1, F.concat(F.lit('{"type":null,"n":'), F.col("event_id").cast("string"), F.lit("}"))).when(kind == 2, F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('"}'))).otherwise("")
    rows = read(spark, sf_dir, "events").select("event_id", F.try_parse_json(line).alias("v")).where("v IS NOT NULL")
    return rows.select("event_id", F.coalesce(F.try_variant_get("v", "$.type", "string"), F.lit("")).alias("kind"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL ELSE event_type END AS source FROM events WHERE CASE event_id % 3 WHEN 0 THEN NULL ELSE event_type END IS DISTINCT FROM 'click'")
def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("source"))
    return S.not_from(rows, "click")


@query("SELECT user_id AS session_id, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 25")
def message_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap on a session's messages, with a small number so that it shows."""
    return M.capped(read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq")), 25)


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 7 = 0 THEN 0 ELSE epoch(date_trunc('day', ts)) END, event_id) AS place FROM events")
def stable_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By time, missing first; ties stay in the order of the input. In blocks of thirty days, as one user
    may have a third of all events."""
    day = F.unix_date(F.to_date(F.col("ts").cast("timestamp_ntz")))
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 7 != 0, day).otherwise(0).alias("day"))
    return running_counts(rows, "user_id", F.floor(F.col("day") / 30), ["day", "event_id"], {"place": F.lit(True)}).drop("day")


@query("SELECT user_id AS session_id, turn FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events) WHERE turn % 20 = 0")
def reminder_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth turn of a session; the twentieth is the feature, not a sample. Counted in blocks
    of a day, as one user may have a third of all events."""
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "ts", "event_id")
    counted = running_counts(events, "session_id", F.to_date("ts"), ["ts", "event_id"], {"turn": F.lit(True)})
    return counted.select("session_id", "turn").where(F.col("turn") % 20 == 0)


@query(f"SELECT session_id, seq, role, n FROM ({_NUMBERED})")
def qa_numbering_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbering of qa_numbering for sessions of any length: in blocks of positions."""
    spoken = M.spoken(messages(spark, sf_dir))
    counted = running_counts(spoken, "session_id", F.floor(F.col("seq") / 4), ["seq"], {"q": F.col("role") == "user", "a": F.col("role") == "assistant"})
    return counted.select("session_id", "seq", "role", F.when(F.col("role") == "user", F.col("q")).otherwise(F.col("a")).alias("n"))
