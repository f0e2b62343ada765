"""The folder of notes: its guard, the lock of a run, the sink, and what notes say at their beginning.

The sink commits a run as a whole. Tasks write into a folder of the run; when all are done, the driver checks
every name, writes a journal and moves the files to their names. A run that ends before its journal leaves the
notes as they were; one that ends after it is finished by the next run, and finishing it twice changes nothing.

Notes are opened relative to the folder and links are never followed: a name that is a link is neither
read nor replaced. Executors open files by themselves, so they must mount the folder.
"""

from __future__ import annotations

import fcntl
import json
import os
import re
import shutil
import stat
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .shared import local_path, ship

#: Fixed value: seconds after which the lock of a run that gave no sign of life counts as left behind.
LOCK_STALE_S = 300
LOCK, MUTEX, RUN, JOURNAL, NAMES = ".sync.lock", ".sync.mutex", ".run-", "journal", "names"
#: Bytes that are read at a time.
BLOCK = 1 << 14
#: What a name must be when a run is committed, besides a time of change: no matter what, or free.
ANY, FREE = None, -1


def guard(folder: str) -> str:
    """The folder's real path; a missing folder is made, a link is refused, an empty path too."""
    if not folder:
        raise ValueError("the folder for notes must be given")
    folder = local_path(folder)
    if os.path.islink(folder.rstrip("/")):
        raise ValueError(f"{folder} is a symbolic link")
    os.makedirs(folder, exist_ok=True)
    return os.path.realpath(folder)


def plain_name(name: str) -> str:
    """The name, if it is one of a file right in a folder that readers see; others are refused."""
    if not name or os.path.basename(name) != name or name.startswith(".") or "\0" in name:
        raise ValueError(f"{name!r} is no file name of the folder")
    return name


@contextmanager
def _opened(folder: str) -> Iterator[int]:
    """A descriptor of a folder that is no link."""
    at = os.open(folder, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW)
    try:
        yield at
    finally:
        os.close(at)


@contextmanager
def _regular(at: int, name: str) -> Iterator[BinaryIO | None]:
    """A file of an opened folder, to read; None for a link, what is no regular file, and what went."""
    try:
        file = os.open(name, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK, dir_fd=at)
    except OSError:
        yield None
        return
    if not stat.S_ISREG(os.fstat(file).st_mode):
        os.close(file)
        yield None
        return
    with open(file, "rb") as f:
        yield f


# -- the lock --------------------------------------------------------------------------------------


@contextmanager
def _mutex(folder: str) -> Iterator[None]:
    """For moments: one process at a time looks at the lock and changes it, or moves a run's files."""
    at = os.open(os.path.join(folder, MUTEX), os.O_RDWR | os.O_CREAT | os.O_NOFOLLOW, 0o600)
    try:
        fcntl.flock(at, fcntl.LOCK_EX)
        yield
    finally:
        os.close(at)


def holder(folder: str) -> str | None:
    """The token of the run that holds the folder."""
    try:
        with open(os.path.join(folder, LOCK), encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError:
        return None


def _take(folder: str, token: str) -> bool:
    path = os.path.join(folder, LOCK)
    with _mutex(folder):
        try:
            if os.path.isdir(path):
                return False  # no lock of this kind, so no one's to remove
            if time.time() - os.stat(path).st_mtime <= LOCK_STALE_S:
                return False
        except FileNotFoundError:
            pass
        temp = f"{path}.{token}"
        with open(temp, "w", encoding="utf-8") as f:
            f.write(token)
        os.replace(temp, path)
    return True


def _live(folder: str, token: str, over: threading.Event) -> None:
    """Signs of life while the run lasts, as long as the lock is its own."""
    while not over.wait(LOCK_STALE_S / 10):
        with _mutex(folder):
            if holder(folder) != token:
                return
            os.utime(os.path.join(folder, LOCK))


@contextmanager
def lock(folder: str) -> Iterator[str | None]:
    """One run at a time in a folder: yields the run's token if it holds the folder, or else None. A run that
    lives never loses the lock; that of one that gave no sign of life for LOCK_STALE_S seconds is taken over, and should
    it go on after all, its commit is refused and the lock of the other stays."""
    token = uuid.uuid4().hex
    if not _take(folder, token):
        yield None
        return
    over = threading.Event()
    beat = threading.Thread(target=_live, args=(folder, token, over), daemon=True)
    beat.start()
    try:
        recover(folder)
        yield token
    finally:
        over.set()
        beat.join()
        with _mutex(folder):
            if holder(folder) == token:
                os.unlink(os.path.join(folder, LOCK))


# -- the sink --------------------------------------------------------------------------------------


def _planned(run: str, tasks: list[str]) -> Iterator[tuple[str, str, int | None]]:
    """(written file, name, what the name must be) of the notes of some tasks."""
    for task in tasks:
        with open(os.path.join(run, task, NAMES), encoding="utf-8") as f:
            for line in f:
                at, name, expects = json.loads(line)
                yield os.path.join(task, str(at)), name, expects


def _move(folder: str, run: str, tasks: list[str], sync: bool = True) -> None:
    """Give a run's files their names, those that have not got it yet, and remove what is left of the run."""
    with _opened(folder) as there, _opened(run) as here:
        for source, name, _ in _planned(run, tasks):
            try:
                os.rename(source, name, src_dir_fd=here, dst_dir_fd=there)
            except FileNotFoundError:
                pass  # moved before
        if sync:
            os.fsync(there)
    shutil.rmtree(run, ignore_errors=True)


def recover(folder: str) -> None:
    """Finish the runs that had their journal, and remove what others have left. For the lock's holder."""
    for name in os.listdir(folder):
        run = os.path.join(folder, name)
        if name.startswith(RUN) and not os.path.islink(run):
            with _mutex(folder):
                try:
                    with open(os.path.join(run, JOURNAL), encoding="utf-8") as f:
                        _move(folder, run, json.load(f))
                except FileNotFoundError:
                    shutil.rmtree(run, ignore_errors=True)


class Conflict(RuntimeError):
    """A note changed, or its name was taken, after the run had read the folder."""


def _changed(at: int, name: str) -> int | None:
    """When a note was changed last, in milliseconds, by the folder's descriptor; None if there is none. A link or
    folder of that name is refused."""
    try:
        found = os.stat(name, dir_fd=at, follow_symlinks=False)
    except FileNotFoundError:
        return None
    if not stat.S_ISREG(found.st_mode):
        raise Conflict(f"{name!r} is no regular file")
    return found.st_mtime_ns // 1_000_000


def _keep(at: int, name: str, expects: int | None, start: int, note: BinaryIO) -> None:
    """Copy the note held, from a byte on, behind what is written of the new one, and end it with one empty line."""
    with _regular(at, name) as f:
        if f is None or expects is not None and os.fstat(f.fileno()).st_mtime_ns // 1_000_000 != expects:
            raise Conflict(f"{name!r} has changed since it was read")
        f.seek(start)
        shutil.copyfileobj(f, note, BLOCK)
    end, text = note.tell(), b""
    while end and not text:
        size = min(end, BLOCK)
        note.seek(end - size)
        text = note.read(size).rstrip(b"\n")
        end -= size - len(text)
    note.seek(end)
    note.truncate()
    note.write(b"\n\n")


class _Task(WriterCommitMessage):
    def __init__(self, folder: str) -> None:
        self.folder = folder


class _Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.folder, self.sync, self.token = options["path"], options.get("sync", "true") == "true", options.get("token")
        self.run = os.path.join(self.folder, RUN + options["run"])

    def write(self, rows) -> WriterCommitMessage:
        task, count, note = uuid.uuid4().hex, 0, None
        os.makedirs(os.path.join(self.run, task))
        with ExitStack() as last, _opened(self.folder) as there, open(os.path.join(self.run, task, NAMES), "w", encoding="utf-8") as names:
            for row in rows:
                if row["filename"] is not None:
                    if note is not None:
                        self._flushed(note)
                    last.close()
                    name, expects, keep_from = plain_name(row["filename"]), row["expects"], row["keep_from"]
                    names.write(json.dumps([count, name, expects]) + "\n")
                    note = last.enter_context(open(os.path.join(self.run, task, str(count)), "w+b"))
                    count += 1
                    note.write(row["markdown"].encode("utf-8"))
                    if keep_from is not None:
                        _keep(there, name, expects, keep_from, note)
                elif note is None:
                    raise ValueError("a piece without a note before it")
                else:
                    note.write(row["markdown"].encode("utf-8"))
            if note is not None:
                self._flushed(note)
            self._flushed(names)
        return _Task(task)

    def _flushed(self, file) -> None:
        file.flush()
        if self.sync:
            os.fsync(file.fileno())

    def commit(self, messages) -> None:
        tasks = [m.folder for m in messages if m is not None]
        if not tasks:
            return
        # No other run takes over, and no other commits, between the checks and the last name.
        with _mutex(self.folder):
            if self.token and holder(self.folder) != self.token:
                raise Conflict("the lock of this run was taken over")
            with _opened(self.folder) as at:
                for _, name, expects in _planned(self.run, tasks):
                    changed = _changed(at, name)
                    if expects == FREE and changed is not None or expects not in (ANY, FREE) and changed != expects:
                        raise Conflict(f"{name!r} has changed since it was read")
            temp = os.path.join(self.run, JOURNAL + ".new")
            with open(temp, "w", encoding="utf-8") as f:
                json.dump(tasks, f)
                self._flushed(f)
            os.replace(temp, os.path.join(self.run, JOURNAL))
            _move(self.folder, self.run, tasks, self.sync)

    def abort(self, messages) -> None:
        if not os.path.exists(os.path.join(self.run, JOURNAL)):
            shutil.rmtree(self.run, ignore_errors=True)


class NoteFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notefiles"

    def schema(self) -> str:
        return "filename string, markdown string, expects long, keep_from long"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def write_notes(notes: DataFrame, folder: str, sync: bool = True, token: str | None = None) -> None:
    """Write filename and markdown of every row, all or none. expects, where there is such a column: the time of
    change (ms) of the note that the row replaces, or FREE; a run whose notes are otherwise by now fails with a
    Conflict and changes nothing. token: of the lock, without which the run is refused. sync: force the files and
    the folder to disk."""
    expects = F.col("expects").cast("long") if "expects" in notes.columns else F.lit(ANY).cast("long")
    _save(notes.select("filename", "markdown", expects.alias("expects"), F.lit(None).cast("long").alias("keep_from")), folder, sync, token)


def write_blocks(rows: DataFrame, blocks: DataFrame, folder: str, sync: bool = True, token: str | None = None) -> None:
    """The same of notes in pieces: rows (session_id, filename, front, expects, keep_from), one for each note, and blocks
    (session_id, seq, block). A note is its front, what the one held has from the byte keep_from on (nothing if that is null)
    with one empty line at its end, and its blocks by seq. Pieces are sorted by note on disk where they are many and
    written one by one, so a note of any length takes a bounded memory; its pieces go through one task."""
    null = lambda t: F.lit(None).cast(t)
    first = rows.select("session_id", F.lit(False).alias("_later"), null("long").alias("_seq"), "filename", F.col("front").alias("markdown"), F.col("expects").cast("long").alias("expects"), F.col("keep_from").cast("long").alias("keep_from"))
    later = blocks.select("session_id", F.lit(True), F.col("seq").cast("long"), null("string"), "block", null("long"), null("long"))
    pieces = first.union(later).repartition("session_id").sortWithinPartitions("session_id", "_later", "_seq")
    _save(pieces.select("filename", "markdown", "expects", "keep_from"), folder, sync, token)


def _save(pieces: DataFrame, folder: str, sync: bool, token: str | None) -> None:
    """Pieces in order: one with a filename begins a note, one without goes on with it."""
    spark: SparkSession = pieces.sparkSession
    real = guard(folder)
    ship(spark)
    spark.dataSource.register(NoteFiles)
    sink = pieces.write.format("notefiles").mode("append").option("path", real)
    sink = sink.option("sync", str(sync).lower()).option("run", uuid.uuid4().hex)
    (sink if token is None else sink.option("token", token)).save()


def _put_rows(folder: str):
    def run(batches):
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                to, temp = os.path.join(folder, plain_name(name)), os.path.join(folder, f".{uuid.uuid4().hex}")
                with open(temp, "wb") as f:
                    f.write(text.encode("utf-8"))
                os.replace(temp, to)
            yield _batch([(batch.num_rows,)], "files long")

    return run


def put_files(files: DataFrame, folder: str) -> None:
    """Write filename and text of every row, each file by the task that has it. No run, no checks, no commit: for files that
    no one reads before all are there; a task that is run again writes the same."""
    real = guard(folder)
    ship(files.sparkSession)
    files.select("filename", "text").mapInArrow(_put_rows(real), "files long").write.format("noop").mode("overwrite").save()


# -- what is read of notes -------------------------------------------------------------------------

#: A line that begins like a message heading, in the lines of Java's patterns: \r and the Unicode ends begin one too.
_HEADING = re.compile(rb"(?:\A|\r|\xc2\x85|\xe2\x80[\xa8\xa9])## [QA][0-9]")
HEAD = "filename string, head string, modified long, headings long"


#: A line that is a message heading.
_MESSAGE = re.compile(r"## ([QA])\d+")
MARKS = "filename string, head string, head_bytes long, q long, a long"


def _front(data: bytes, ended: bool) -> int:
    """The byte behind the line that ends the front matter, 0 without any, -1 if that can't be told yet."""
    if not data.startswith(b"---\n"):
        return -1 if not ended and b"---\n".startswith(data) else 0
    at = data.find(b"\n---\n", 3)
    if at >= 0:
        return at + 5
    return -1 if not ended else len(data) if data.endswith(b"\n---") else 0


def _read_front(f: BinaryIO) -> bytes:
    """The front matter of a note, with its two lines; no more is read than that needs."""
    data = more = f.read(BLOCK)
    while (end := _front(data, not more)) < 0:
        data += (more := f.read(BLOCK))
    return data[:end]


def marks_of(at: int, name: str) -> tuple[str, int, int, int] | None:
    """The front matter of a note, its bytes, and how many headings of questions and answers the note has outside
    fenced code; by the folder's descriptor, in blocks. None for what is no regular file, or went."""
    with _regular(at, name) as f:
        if f is None:
            return None
        head = _read_front(f)
        f.seek(0)
        code, begins, found = False, True, {"Q": 0, "A": 0}
        while piece := f.readline(BLOCK):  # the rest of a longer line begins no line
            if begins and piece.startswith(b"```"):
                code = not code
            elif begins and not code and (m := _MESSAGE.fullmatch(piece.removesuffix(b"\n").decode("utf-8", "replace"))):
                found[m[1]] += 1
            begins = piece.endswith(b"\n")
        return head.decode("utf-8", "replace"), len(head), found["Q"], found["A"]


def head_of(at: int, name: str, whole: bool) -> tuple[str, int, int | None] | None:
    """The front matter of a note, when it was changed last (ms) and, if whole, how many of its lines begin like
    a message heading; by the folder's descriptor. None for what is no regular file, or went."""
    with _regular(at, name) as f:
        if f is None:
            return None
        found = os.fstat(f.fileno())
        head = _read_front(f)
        headings = None
        if whole:
            f.seek(0)
            headings = sum(len(_HEADING.findall(line)) for line in f)
        return head.decode("utf-8", "replace"), found.st_mtime_ns // 1_000_000, headings


def _head_rows(folder: str, whole: bool):
    def run(batches):
        with _opened(folder) as at:
            for batch in batches:
                yield _batch([(name, *found) for name in batch.column(0).to_pylist() if (found := head_of(at, name, whole))], HEAD)

    return run


def _listed(folder: str):
    def run(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                rows = []
                with os.scandir(folder) as entries:
                    for e in entries:
                        if e.name.endswith(".md") and not e.name.startswith("."):
                            try:
                                found = e.stat(follow_symlinks=False)
                            except FileNotFoundError:
                                continue
                            rows.append((e.name, found.st_size, found.st_mtime_ns // 1_000_000, stat.S_ISREG(found.st_mode)))
                        if len(rows) == 10_000:
                            yield _batch(rows, LISTED)
                            rows = []
                yield _batch(rows, LISTED)

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


LISTED = "filename string, length long, modified long, regular boolean"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """filename, length, modified (ms) of what is named like a note right in a folder, empty files and links too; regular: whether it
    is a file and no link. A folder is listed by one task."""
    ship(spark)
    return spark.range(0, 1, 1, 1).mapInArrow(_listed(folder), LISTED)


def _text_rows(folder: str):
    def run(batches):
        with _opened(folder) as at:
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    with _regular(at, name) as f:
                        if f is not None:
                            yield _batch([(name, f.read().decode("utf-8", "replace"))], "filename string, markdown string")

    return run


def note_texts(names: DataFrame, folder: str) -> DataFrame:
    """filename and markdown of the notes that names (filename) lists; links and what is gone are left out."""
    ship(names.sparkSession)
    return names.select("filename").mapInArrow(_text_rows(folder), "filename string, markdown string")


def heads(names: DataFrame, folder: str, whole: bool) -> DataFrame:
    """filename, head (the front matter with its two lines), modified (ms), headings of the notes that names
    (filename) lists; links and what is gone are left out. No text leaves a task; headings is null unless whole."""
    ship(names.sparkSession)
    return names.select("filename").mapInArrow(_head_rows(folder, whole), HEAD)


def _mark_rows(folder: str):
    def run(batches):
        with _opened(folder) as at:
            for batch in batches:
                yield _batch([(name, *found) for name in batch.column(0).to_pylist() if (found := marks_of(at, name))], MARKS)

    return run


def marks(names: DataFrame, folder: str) -> DataFrame:
    """MARKS of the notes that names (filename) lists; links and what is gone are left out. No text leaves a task."""
    ship(names.sparkSession)
    return names.select("filename").mapInArrow(_mark_rows(folder), MARKS)
