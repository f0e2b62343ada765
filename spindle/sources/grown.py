"""A stream over line files that grow in place: each batch holds the lines that came since the one before.

Spark's own file stream never reports a known file again. Here the offset of a batch holds, for each
file, up to which byte it has whole lines; a batch reads from the old one to the new, in ranges of bounded size,
so a large file is many tasks. A last line without an end waits for its rest. A file that is shorter than
before, or begins with another line, was truncated or replaced and is read from its beginning. A file
that is rewritten with the same first line and no less text counts as one that grew.

The offset is kept in the stream's checkpoint, so a restart neither repeats nor skips a line. It has an entry of
a path and two numbers for each file. Files are opened by their path, which driver and executors must share.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Iterator
from fnmatch import fnmatch

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .shared import local_path, ship

#: Bytes that one task reads at most, into how many tasks less is dealt, and bytes that are looked through at a
#: time for a line's end.
RANGE, SPREAD, STEP = 64 << 20, 64, 1 << 16


def last_line_end(file, size: int) -> int:
    """The byte behind the last line end among the first size bytes, or 0."""
    at = size
    while at > 0:
        start = max(0, at - STEP)
        file.seek(start)
        found = file.read(at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return 0


def whole_lines(path: str) -> tuple[int, int] | None:
    """Up to which byte a file has whole lines, and the checksum of its first line; None without any."""
    with open(path, "rb") as file:
        end = last_line_end(file, os.fstat(file.fileno()).st_size)
        if not end:
            return None
        file.seek(0)
        return end, zlib.crc32(file.readline())


def lines_between(path: str, start: int, stop: int) -> Iterator[tuple[int, str]]:
    """(place, line) of the lines that begin from start to stop, which is no more than the end of the whole
    lines. Places are bytes. A line ends at \\n, \\r or both; blank lines are left out."""
    with open(path, "rb") as file:
        file.seek(max(0, start - 1))
        if start and file.read(1) != b"\n":
            file.readline()  # it began in the range before
        while (at := file.tell()) < stop:
            for part in file.readline().removesuffix(b"\n").split(b"\r"):
                text = part.removeprefix(b"\xef\xbb\xbf") if not at else part
                if text:
                    yield at, text.decode("utf-8", "replace")
                at += len(part) + 1


class _Ranges(InputPartition):
    """(path, start, stop, anew) of the ranges that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int, bool]]) -> None:
        self.ranges = ranges


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.pattern, self.range = options["path"], options.get("pattern", "*"), int(options.get("range", RANGE))
        self.known: dict[str, tuple] = {}  # what a file's size and time were, and its entry

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Of each file below the folder that has a whole line. Files of the same size and time are not opened again."""
        now: dict[str, tuple] = {}
        for folder, _, names in os.walk(self.folder):
            for name in names:
                path = os.path.join(folder, name)
                if not fnmatch(name, self.pattern) or os.path.islink(path):
                    continue
                try:
                    status = os.stat(path)
                    seen = (status.st_size, status.st_mtime_ns)
                    held = self.known.get(path)
                    now[path] = held if held and held[0] == seen else (seen, whole_lines(path))
                except FileNotFoundError:
                    continue  # it went meanwhile
        self.known = now
        return {path: list(entry) for path, (_, entry) in sorted(now.items()) if entry}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = []
        for path, (stop, first) in end.items():
            before, first_before = start.get(path, (0, first))
            anew = path not in start or first != first_before or stop < before
            if stop > (at := 0 if anew else before):
                new.append((path, at, stop, anew))
        # Many small files share a task, a large one has several.
        most = min(self.range, max(1 << 20, sum(stop - at for _, at, stop, _ in new) // SPREAD))
        out: list[InputPartition] = []
        ranges: list[tuple[str, int, int, bool]] = []
        room = most
        for path, at, stop, anew in new:
            while at < stop:
                upto = min(stop, at + room)
                ranges.append((path, at, upto, anew))
                room, at = room - (upto - at), upto
                if not room:
                    out.append(_Ranges(ranges))
                    ranges, room = [], most
        return [*out, _Ranges(ranges)] if ranges else out

    def read(self, partition: _Ranges) -> Iterator[tuple]:
        for path, start, stop, anew in partition.ranges:
            for place, line in lines_between(path, start, stop):
                yield path, place, anew, line

    def commit(self, end: dict) -> None:
        pass


class GrownLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grownlines"

    def schema(self) -> str:
        return "path string, place long, anew boolean, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def grown_lines(spark: SparkSession, folder: str, pattern: str = "*", most_bytes: int = RANGE) -> DataFrame:
    """A stream of path, place, anew, line from the files anywhere below a folder. place: the byte at which the
    line begins. anew: the batch reads its file from the beginning, so what earlier batches had of it no
    longer counts. Links are not followed; an empty or missing folder gives nothing; invalid UTF-8 is replaced."""
    ship(spark)
    # The process that plans a stream does not see what was shipped, so the source goes along as a value.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(GrownLines)
    return spark.readStream.format("grownlines").option("path", local_path(folder)).option("pattern", pattern).option("range", str(most_bytes)).load()
