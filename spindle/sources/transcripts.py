"""Readers of chat transcripts: each gives rows with a position column, as Spark keeps no order.

Files are chosen before they are opened: a listing (path, name, length, time) is joined with the keys that
are wanted, and the paths that are left go to the scan as a filter on its metadata, so that the others
are not read. Line files are read in byte ranges, a large one by many tasks; malformed lines are dropped one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import content as C
from ..functions import text as T
from ..operators import messages as M
from ..operators import notes as N
from ..operators import sync as S
from ..operators.running import block_of, running_sums
from . import note_files
from .shared import exists, gathered, stage

#: Fixed value: a conversation of the export, as far as it is read.
EXPORT_SCHEMA = (
    "title string, create_time double, mapping map<string,struct<message:struct<author:struct<role:string>,"
    "content:struct<parts:array<variant>>,create_time:double>>>"
)


#: Paths that are named to a scan at most; of more, the rows are joined with them.
NAMED = 10_000
#: Bytes of a line file up to which it is read as one value, unless Spark's parts are smaller; larger ones are read in byte ranges.
SMALL_FILE = 1 << 20


def _file_name() -> Column:
    """A file's name; the metadata has it percent-encoded, with a + as it is."""
    return F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))


def listed(spark: SparkSession, paths: str | list[str], pattern: str) -> DataFrame:
    """path, file, length, modified of the files anywhere below the paths; none is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(paths)
    return found.select(F.col("_metadata.file_path").alias("path"), _file_name().alias("file"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("modified"))


def _keyed(files: DataFrame, ending: str, wanted: DataFrame | None, held: DataFrame | None) -> DataFrame:
    """Of listed files those named <session_id><ending> for an id that is wanted (all if None) and not held."""
    keyed = files.withColumn("session_id", F.regexp_replace("file", rf"\{ending}\z", ""))
    if wanted is not None:
        keyed = keyed.join(wanted.select("session_id"), "session_id", "left_semi")
    return keyed if held is None else keyed.join(held.select("session_id"), "session_id", "left_anti")


def _of_files(found: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """Rows of a file scan from the files chosen (path), or from all. Up to NAMED paths are a filter on metadata,
    by which the scan leaves out the other files unopened."""
    if chosen is None:
        return found
    paths = chosen.select("path").distinct()
    names = [r["path"] for r in paths.limit(NAMED + 1).collect()]
    path = F.col("_metadata.file_path")
    return found.where(path.isin(names)) if len(names) <= NAMED else found.withColumn("_path", path).join(paths, F.col("_path") == paths["path"], "left_semi").drop("_path")


def _binary(spark: SparkSession, paths: str | list[str], pattern: str, recursive: bool = True) -> DataFrame:
    """value, _metadata: whole files as text, their bytes as they are. Many small files are the usual case, and opening
    one costs the reader of binary files a fraction of what it costs the reader of text."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(paths).select(F.col("content").cast("string").alias("value"), "_metadata")


def _whole(spark: SparkSession, paths: str | list[str], pattern: str, chosen: DataFrame | None = None) -> DataFrame:
    found = _binary(spark, paths, pattern)
    return gathered(_of_files(found.select("value", F.col("_metadata.file_path").alias("path"), _file_name().alias("file"), "_metadata"), chosen).drop("_metadata"))


def _place() -> Column:
    """A number that rises from row to row of a file, which may be read by many tasks: twice the byte at which
    a task's range begins, and the number of rows that the task has read before. These are no more than the bytes
    before the row in the range and in the smaller ranges that share the task, and a range that is not its file's
    last fills a task."""
    before = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_block_start") * 2 + before


def text_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, place, line): all lines of the files below a path, read in byte ranges; place rises from line to line of a file."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return found.select(_file_name().alias("file"), _place().alias("place"), F.col("value").alias("line"))


def _lines(spark: SparkSession, paths: str | list[str], pattern: str, chosen: DataFrame | None = None) -> DataFrame:
    """(path, file, place, v): the lines that are JSON objects; all others are malformed or blank.

    place rises from line to line of a file. A line ends at \\n, \\r or both, invalid UTF-8 is replaced, and a byte order
    mark is left out."""
    files, size = _binary(spark, paths, pattern), F.col("_metadata.file_size")
    most = min(SMALL_FILE, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    named = [F.col("_metadata.file_path").alias("path"), _file_name().alias("file")]
    lines = F.split(F.regexp_replace("value", "\\A\ufeff", ""), "\r\n?|\n", -1)
    small = gathered(_of_files(files.where(size <= most), chosen).select(*named, "value"))
    found = small.select("path", "file", F.posexplode(lines).alias("place", "value")).withColumn("place", F.col("place").cast("long"))
    if not files.where(size > most).isEmpty():  # a filter of the listing
        ranges = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(paths)
        large = _of_files(ranges.select("value", "_metadata").where(size > most), chosen)
        found = found.unionByName(large.select(*named, _place().alias("place"), "value"))
    placed = found.select("path", "file", "place", _parsed("value").alias("v"))
    return placed.where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))


def _parsed(text: str) -> Column:
    """A column's JSON, or null, as a generated column: conditions on it then do not go below it, where each would parse anew."""
    return F.explode(F.array(F.try_parse_json(text)))


def _variant(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _text(v: Column, path: str) -> Column:
    """A field as text; missing and null are null."""
    return F.try_variant_get(v, path, "string")


def _told(v: Column, path: str) -> Column:
    """A field as text; missing, null and false are empty."""
    x = _variant(v, path)
    false = (F.schema_of_variant(x) == "BOOLEAN") & (x.cast("string") == "false")
    return F.coalesce(F.when(~F.coalesce(false, F.lit(False)), _text(v, path)), F.lit(""))


# -- export: one JSON array of conversations -------------------------------------------------------


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """file, at (from 0), text: the objects right in the JSON array that a file holds, in order. A file of any
    size is read in byte ranges; an object is one row. A file that is no array gives nothing.

    Files are read up to each closing brace. A brace in a string is told by the quotes before it, the end of an object
    by the depth there: running sums over the pieces, in blocks, of a few numbers each. No escape runs across a
    piece, since what ends it is no backslash."""
    found = spark.read.option("lineSep", "}").text(path).select("value", "_metadata")
    pieces = stage(found.select(F.col("_metadata.file_path").alias("path"), _file_name().alias("file"), _place().alias("place"), F.col("value").alias("piece")), "pieces")
    parts = F.split(F.regexp_replace("piece", r"(?s)\\.", ""), '"', -1)
    many = lambda t, c: F.length(t) - F.length(F.translate(t, c, ""))

    def deeper(inside: int) -> Column:
        """By how much a piece that begins outside (0) or inside (1) a string changes the depth, its brace included."""
        outside = F.array_join(F.filter(parts, lambda _, i: i % 2 == inside), "")
        return many(outside, "{[") - many(outside, "}]") - ((F.size(parts) - 1 + inside) % 2 == 0).cast("int")

    # The numbers go without the text. A file's first piece says whether it is an array.
    told = pieces.select("path", "place", (F.size(parts) - 1).alias("quotes"), deeper(0).alias("out"), deeper(1).alias("in"))
    arrays = pieces.groupBy("path").agg(F.min_by("piece", "place").alias("first")).where(F.col("first").rlike(r"\A\s*\[")).select("path")
    sums = lambda rows, **n: running_sums(rows, "path", block_of("place"), ["place"], n)
    parity = sums(told.join(arrays, "path", "left_semi"), _quotes=F.col("quotes"))
    begun = (F.col("_quotes") - F.col("quotes")) % 2 == 1
    depth = sums(parity.select("path", "place", (F.col("_quotes") % 2 == 0).alias("closed"), F.when(begun, F.col("in")).otherwise(F.col("out")).alias("deeper")), _depth=F.col("deeper"))
    ends = depth.select("path", "place", (F.col("closed") & (F.col("_depth") == 1)).cast("int").alias("ends"))
    placed = stage(sums(ends, _ends=F.col("ends")).select("path", "place", (F.col("_ends") - F.col("ends")).alias("at"), (F.col("ends") == 1).alias("ends")), "piece-objects")
    each = pieces.join(placed, ["path", "place"]).groupBy("path", "file", "at").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("p"), F.max("ends").alias("whole"))
    text = F.concat(F.array_join(F.transform("p", lambda x: x["piece"]), "}"), F.lit("}"))
    cut = each.where("whole").select("file", F.col("at").cast("int").alias("at"), F.regexp_replace(text, r"\A\s*[\[,]\s*", "").alias("text"))
    # What stands between two objects and is none goes: the object is the last of these elements.
    among = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.col("text"), F.lit("]"))), "$", "array<variant>")
    alone = F.when(F.startswith("text", F.lit("{")), F.col("text")).otherwise(F.to_json(F.try_element_at(among, F.lit(-1))))
    return cut.select("file", "at", alone.alias("text")).where("text IS NOT NULL")


def export_conversations(spark: SparkSession, path: str) -> DataFrame:
    """session_id (the file's name and the position in it), file, at (that position), title, started_at
    (epoch seconds), mapping. What is no object in an export, or no conversation, is left out."""
    rows = array_objects(spark, path).select("file", "at", F.from_json("text", EXPORT_SCHEMA).alias("c")).where("c.mapping IS NOT NULL")
    session_id = F.concat_ws("#", "file", F.lpad(F.col("at").cast("string"), 9, "0"))
    return rows.select(session_id.alias("session_id"), "file", "at", F.coalesce("c.title", F.lit("Untitled")).alias("title"), F.col("c.create_time").alias("started_at"), "c.mapping")


def export_messages(conversations: DataFrame, *carry: str) -> DataFrame:
    """session_id, seq, role, text and the columns carry: messages with a text of user or assistant, by
    time, those without one first, ties in the order of the export. A blank text is kept."""
    nodes = conversations.select("session_id", *carry, F.posexplode(F.map_entries("mapping")).alias("at", "e")).select("session_id", *carry, "at", F.col("e.value.message").alias("m"))
    kept = nodes.select("session_id", *carry, "at", F.col("m.author.role").alias("role"), C.flatten_export(F.col("m.content.parts")).alias("text"), F.coalesce("m.create_time", F.lit(0.0)).alias("time"))
    ordered = M.spoken(kept).where("text IS NOT NULL").withColumn("key", F.struct("time", "at"))
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("key")).cast("long") - 1
    return ordered.select("session_id", *carry, seq.alias("seq"), "role", "text")


# -- session documents, with event logs as the fallback --------------------------------------------


def session_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """session_id, source of the listed sessions. A file without a list of sessions stops the run."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<sessions:array<struct<session_id:string,source:string>>>").alias("c"))
    listed = F.when(F.col("c.sessions").isNull(), F.raise_error(F.lit("the catalogue has no list of sessions"))).otherwise(F.col("c.sessions"))
    return rows.select(F.explode(listed).alias("s")).select("s.session_id", "s.source")


def session_documents(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """session_id (of the file name), source, started_at, content: one <session_id>.json each, of the
    sessions wanted (session_id) or all; other files are not opened. Files that are no JSON, or JSON null
    or false, are left out, as if they could not be read."""
    chosen = None if wanted is None else _keyed(listed(spark, path, "*.json"), ".json", wanted, None)
    rows = _whole(spark, path, "*.json", chosen).select(F.regexp_replace("file", r"\.json\z", "").alias("session_id"), _parsed("value").alias("v"))
    usable = rows.where("v IS NOT NULL").where(~F.is_variant_null("v") & ~((F.schema_of_variant("v") == "BOOLEAN") & (F.to_json("v") == "false")))
    items = F.coalesce(F.try_variant_get("v", "$.messages", "array<variant>"), F.array().cast("array<variant>"))
    each = F.transform(items, lambda m: F.struct(F.coalesce(_text(m, "$.role"), F.lit("")).alias("role"), _variant(m, "$.content").alias("content")))
    return usable.select("session_id", _told(F.col("v"), "$.source").alias("source"), _told(F.col("v"), "$.timestamp").alias("started_at"), each.alias("items"))


def event_log_documents(spark: SparkSession, paths: str | list[str], cap: int = M.MESSAGE_CAP, wanted: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """The same columns from <session_id>.jsonl event logs anywhere below the paths: of equal names, the
    smallest path; of each session, the first ``cap`` messages of user or assistant with a text. Only logs of
    sessions that are wanted (session_id; all if None) and not held (none if None) are opened."""
    one = _keyed(listed(spark, paths, "*.jsonl"), ".jsonl", wanted, held).groupBy("session_id").agg(F.min("path").alias("path"))
    found = _lines(spark, paths, "*.jsonl", one).withColumn("file", F.regexp_replace("file", r"\.jsonl\z", ""))
    lines = found.where(_text(F.col("v"), "$.sessionId") == F.col("file"))
    role = F.coalesce(_text(F.col("v"), "$.message.role"), _text(F.col("v"), "$.type"))
    events = lines.select(F.col("file").alias("session_id"), "path", F.col("place").alias("seq"), role.alias("role"), F.coalesce(_text(F.col("v"), "$.timestamp"), F.lit("")).alias("time"), C.flatten_event(_variant(F.col("v"), "$.message.content")).alias("text"))
    # The lines are parsed once: both the time and the messages come from this table.
    known = stage(M.spoken(events), "log-events")
    began = known.groupBy("session_id", "path").agg(F.min_by("time", F.when(F.col("time") != "", F.col("seq"))).alias("started_at"))
    kept = M.capped(M.without_blank(known), cap)
    items = kept.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text"))).alias("items"))
    each = F.transform("items", lambda m: F.struct(m["role"].alias("role"), F.to_variant_object(F.array(m["text"])).alias("content")))
    source = F.when(F.contains("path", F.lit("/.codex/")), "codex").otherwise("claude")
    return items.join(began, "session_id").select("session_id", source.alias("source"), F.coalesce("started_at", F.lit("")).alias("started_at"), each.alias("items"))


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Every session of either side, from the first where it is there; used_fallback says which."""
    rest = fallback.join(primary.select("session_id"), "session_id", "left_anti")
    return primary.withColumn("used_fallback", F.lit(False)).unionByName(rest.withColumn("used_fallback", F.lit(True)))


def session_messages(documents: DataFrame) -> DataFrame:
    """session_id, seq, role, text, title_text of all messages in the documents' order."""
    rows = documents.select("session_id", F.posexplode("items").alias("seq", "m"))
    content = F.col("m.content")
    return rows.select("session_id", "seq", "m.role", C.flatten_body(content).alias("text"), C.flatten_title(content).alias("title_text"))


def said(items: Column) -> Column:
    """seq, role, text and title (what each could give as one) of a document's messages, in its own row: its order is that of the
    document, and nothing is shuffled."""
    return F.transform(items, lambda m, i: F.struct(i.alias("seq"), m["role"].alias("role"), C.flatten_body(m["content"]).alias("text"), T.title_of(C.flatten_title(m["content"])).alias("title")))


# -- rollout files ---------------------------------------------------------------------------------


def rollout_lines(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, "rollout-*.jsonl")


def grown_rollout_lines(lines: DataFrame) -> DataFrame:
    """The same of a batch of grown_lines, with anew."""
    parsed = lines.select("path", "place", "anew", F.try_parse_json("line").alias("v"))
    return parsed.where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))


def rollout_events(lines: DataFrame, *carry: str) -> DataFrame:
    """path, place, session (id and time of a session_meta line), said (role and text of a message
    line) and the columns carry: what the sync needs of the lines, parsed once. The event's own time stands
    in where the payload has no timestamp."""
    v = F.col("v")
    kind, stamp = _text(v, "$.type"), _variant(v, "$.payload.timestamp")
    time = F.when(stamp.isNull(), F.coalesce(_text(v, "$.timestamp"), F.lit(""))).otherwise(F.coalesce(F.try_variant_get(stamp, "$", "string"), F.lit("")))
    session = F.when(kind == "session_meta", F.struct(F.coalesce(_text(v, "$.payload.id"), F.lit("")).alias("session_id"), time.alias("started_at")))
    message = (kind == "response_item") & (_text(v, "$.payload.type") == "message")
    said = F.when(message, F.struct(_text(v, "$.payload.role").alias("role"), C.flatten_rollout(_variant(v, "$.payload.content")).alias("text")))
    return lines.select("path", "place", *carry, session.alias("session"), said.alias("said")).where("session IS NOT NULL OR said IS NOT NULL")


def rollout_sessions(events: DataFrame) -> DataFrame:
    """path, session_id, started_at: of each file's first session_meta line."""
    meta = events.where("session IS NOT NULL")
    return meta.groupBy("path").agg(F.min_by("session", "place").alias("m")).select("path", "m.*")


def rollout_messages(events: DataFrame) -> DataFrame:
    """path, seq, role, text: the messages with a text; system context of the user goes."""
    rows = events.where("said IS NOT NULL").select("path", F.col("place").alias("seq"), "said.*")
    return M.without_blank(M.without_context(M.spoken(rows)))


def rollout_validated(sessions: DataFrame) -> DataFrame:
    """With date and reason: why a session fails, or null."""
    date = T.date_prefix(F.col("started_at"))
    reason = (
        F.when((F.col("session_id") == "") | (F.col("started_at") == ""), "missing id or timestamp")
        .when(~T.is_uuid(F.col("session_id")), "bad id")
        .when(~T.is_date(date), "bad date")
    )
    return sessions.select("*", date.alias("date"), reason.alias("reason"))


# -- what is written already -----------------------------------------------------------------------


def notes_snapshot(spark: SparkSession, folder: str, links: tuple[str, ...] = (), anywhere: bool = False) -> DataFrame:
    """session_id, filename, markdown, msg_count, q_count, a_count, headings of the notes in a folder (not
    below it). msg_count is null for a note without a valid one; headings counts all lines like one. links:
    names that are symbolic links, which Spark's readers would follow; they are left out. anywhere:
    see front_matter_text."""
    files = _binary(spark, folder, "*.md", recursive=False)
    rows = gathered(files.select(F.col("value").alias("markdown"), _file_name().alias("filename")))
    if links:
        rows = rows.where(~F.col("filename").isin(*links))
    note = F.col("markdown")
    named = rows.select(N.stored_session_id(note, anywhere).alias("session_id"), "filename", "markdown", N.stored_msg_count(note, anywhere).alias("msg_count"))
    found = N.fenced_heading_counts(note)
    return named.select("*", found["q"].alias("q_count"), found["a"].alias("a_count"), N.heading_count(note).alias("headings"))


#: What an index knows of a note: the file it was read from (length and time, ms, of change) and what its
#: beginning said; created notes are entered by session and name alone.
INDEX = "session_id string, filename string, length long, modified long, msg_count int, headings long"


def append_index(rows: DataFrame, path: str) -> None:
    """Append notes to a tab-separated index: session_id and filename, and what else of INDEX rows have."""
    columns = [F.col(n) if n in rows.columns else F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in INDEX.split(", "))]
    rows.select(columns).write.mode("append").option("sep", "\t").csv(path)


def held_notes(spark: SparkSession, folder: str, index: str | None = None, whole: bool = False) -> S.Notes:
    """The notes right in a folder that executors mount: their beginnings, in place, and texts when asked for. Links
    are left out. whole: count headings, for which texts are read, but none is moved.

    index: notes that it holds with the length and time that the listing shows have not changed since, and are not
    opened; the others are read once and entered, notes without a session too."""
    names = stage(note_files.listing(spark, folder), "note-names")
    regular = names.where("regular")
    rest, known = regular, None
    if index is not None and exists(spark, index):
        entries = spark.read.option("sep", "\t").schema(INDEX).csv(index).where("modified IS NOT NULL" + (" AND headings IS NOT NULL" if whole else ""))
        key = ["filename", "length", "modified"]
        entries = entries.groupBy(key).agg(F.max(F.struct("session_id", "msg_count", "headings")).alias("e"))
        known = regular.join(entries, key).select("e.session_id", "filename", "length", "modified", "e.msg_count", "e.headings")
        known = stage(known, "indexed-notes")
        rest = regular.join(known.select("filename"), "filename", "left_anti")
    head = F.col("head")
    told = note_files.heads(rest.repartition(spark.sparkContext.defaultParallelism), folder, whole).withColumnRenamed("modified", "now")
    read = told.join(rest.select("filename", "length", "modified"), "filename")
    read = stage(read.select(N.stored_session_id(head).alias("session_id"), "filename", "length", "modified", N.stored_msg_count(head).alias("msg_count"), "headings", "now"), "note-heads")
    if index is not None:
        append_index(read.where("now = modified"), index)
    columns = ["session_id", "filename", "msg_count", "headings"]
    heads = read.select(*columns, F.col("now").alias("modified"))
    if known is not None:
        heads = heads.unionByName(known.select(*columns, "modified"))

    return S.Notes(heads, names.select("filename"), lambda wanted: note_files.note_texts(wanted, folder), lambda wanted: note_files.marks(wanted, folder))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One file name of each session id of an index: the first by file and name."""
    rows = spark.read.option("sep", "\t").schema(INDEX).csv(path)
    return rows.where("session_id IS NOT NULL").groupBy("session_id").agg(F.min("filename").alias("filename"))
