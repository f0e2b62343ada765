"""Notes: names, front matter in three dialects, and what can be read back from a note's text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import stage
from .running import block_of, running_counts

#: Labels of the sources.
SOURCE_LABELS = {"claude": "Claude Code", "codex": "Codex"}


@dataclass(frozen=True)
class Dialect:
    """How a pipeline writes its notes."""

    name: str
    sanitize: object
    source_label: str | None  # None: by the row's source
    has_session_id: bool
    has_msg_count: bool


EXPORT = Dialect("export", T.sanitize_export, "ChatGPT", False, False)
SESSION = Dialect("session", T.sanitize_session, None, True, False)
ROLLOUT = Dialect("rollout", T.sanitize_rollout, "Codex", True, True)


def source_label(source: Column) -> Column:
    out = source
    for name, label in SOURCE_LABELS.items():
        out = F.when(source == name, label).otherwise(out)
    return out


def front_matter(dialect: Dialect) -> Column:
    """From the columns date, title and, by dialect, source, session_id and msg_count; with the heading
    and the empty line after it."""
    title = F.concat(F.lit('title: "'), T.yaml_escape(F.col("title")), F.lit('"'))
    lines = [F.lit("---"), F.concat(F.lit("date: "), F.col("date")), title]
    quoted = dialect.source_label is None
    if quoted:
        lines.append(F.concat(F.lit('source: "'), T.yaml_escape(source_label(F.col("source"))), F.lit('"')))
        lines.append(F.concat(F.lit('session_id: "'), T.yaml_escape(F.col("session_id")), F.lit('"')))
        lines += [F.lit("tags:"), F.concat(F.lit('  - "'), T.yaml_escape(F.col("source")), F.lit('"'))]
    else:
        lines.append(F.lit(f"source: {dialect.source_label}"))
        if dialect.has_session_id:
            lines.append(F.concat(F.lit("session_id: "), F.col("session_id")))
        if dialect.has_msg_count:
            lines.append(F.concat(F.lit("msg_count: "), F.col("msg_count").cast("string")))
        tag = dialect.source_label.lower()
        lines += [F.lit("tags:"), F.lit(f"  - {tag}")] if dialect.has_session_id else [F.lit(f"tags: [{tag}]")]
    head = T.heading_export(F.col("title")) if dialect is EXPORT else T.heading(F.col("title"))
    return F.concat_ws("\n", *lines, F.lit("---"), F.lit(""), F.concat(F.lit("# "), head), F.lit(""), F.lit(""))


def markdown(dialect: Dialect) -> Column:
    """Front matter and body. Exported notes end with one line end, the others with an empty line."""
    whole = F.concat(front_matter(dialect), F.col("body"))
    return F.regexp_replace(whole, r"\n\n\z", "\n") if dialect is EXPORT else whole


def base_name(dialect: Dialect) -> Column:
    """The file name without .md, before collisions are resolved."""
    parts = [F.col("date"), dialect.sanitize(F.col("title"))]
    if dialect is SESSION:
        parts.append(T.short_id(F.col("session_id")))
    elif dialect is ROLLOUT:
        parts.append(F.substring("session_id", 1, T.SHORT_ID))
    return F.concat_ws("_", *parts)


def _with_number(base: Column, number: Column) -> Column:
    return F.concat(base, F.when(number > 0, F.concat(F.lit("_"), number.cast("string"))).otherwise(""), F.lit(".md"))


def numbered_names(rows: DataFrame, base: str, order: list[str], block: Column) -> DataFrame:
    """filename: the first of a base keeps it, the next get _1, _2, ... in the given order. block: see
    running_counts; one base may have any number of rows."""
    counted = running_counts(rows, base, block, order, {"_nth": F.lit(True)})
    return counted.withColumn("filename", _with_number(F.col(base), F.col("_nth") - 1)).drop("_nth")


def free_names(rows: DataFrame, base: str, taken: DataFrame, order: list[str], block: Column) -> DataFrame:
    """filename: the base if no file has it, or else the base with the smallest free _n, n from 1.
    taken has the column filename. Rows of one base get different names, in the given order.

    Before the used slot u, the j-th of its base, u - j slots are free; so the row numbered nth (from 0)
    has as many used slots below its own as have u - j <= nth. They are counted as rows of one
    order, in blocks, so neither a base of many rows nor one of many files is held in one place.
    """
    carried = rows.columns
    counted = stage(running_counts(rows, base, block, order, {"_nth": F.lit(True)}), "numbered")
    stem = F.regexp_replace("filename", r"\.md\z", "")
    # Names "x", "x_1", "x_2": each may use up slot 0 of its own stem and a slot of the shorter one.
    own = taken.select(stem.alias("_base"), F.lit(0).cast("long").alias("_slot"))
    suffix = taken.where(stem.rlike(r"_[1-9][0-9]{0,17}\z")).select(F.regexp_replace(stem, r"_[0-9]+\z", "").alias("_base"), F.regexp_extract(stem, r"_([0-9]+)\z", 1).cast("long").alias("_slot"))
    used = stage(own.unionByName(suffix).distinct().join(counted.select(F.col(base).alias("_base")).distinct(), "_base", "left_semi"), "used-slots")
    if used.isEmpty():
        return counted.withColumn("filename", _with_number(F.col(base), F.col("_nth") - 1)).select(*(F.col(f"`{c}`") for c in carried), "filename")
    ranked = running_counts(used, "_base", block_of("_slot"), ["_slot"], {"_j": F.lit(True)})
    here = counted.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried))).alias("_row"), F.col(base).alias("_base"), (F.col("_nth") - 1).alias("_place"), F.lit(False).alias("_used"))
    there = ranked.select(F.lit(None).cast(here.schema["_row"].dataType).alias("_row"), "_base", (F.col("_slot") - F.col("_j") + 1).alias("_place"), F.lit(True).alias("_used"))
    both = running_counts(here.unionByName(there).withColumn("_late", ~F.col("_used")), "_base", block_of("_place"), ["_place", "_late"], {"_below": F.col("_used")})
    found = both.where(~F.col("_used"))
    return found.select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(carried)), _with_number(F.col("_base"), F.col("_place") + F.col("_below")).alias("filename"))


def front_matter_text(note: Column, anywhere: bool = False) -> Column:
    """What stands between the first line --- and the next one; empty if the note begins otherwise, unless
    it may stand anywhere."""
    return F.regexp_extract(note, (r"(?:\A|\n)" if anywhere else r"\A") + r"---\n((?s:.*?\n)??)---(?:\n|\z)", 1)


def stored_session_id(note: Column, anywhere: bool = False) -> Column:
    """The session id of a note's front matter, unescaped, or null."""
    matter = front_matter_text(note, anywhere)
    quoted = F.regexp_extract(matter, r'(?m)^session_id:[ \t]*"((?:[^"\\]|\\.)*)"[ \t]*$', 1)
    bare = F.regexp_extract(matter, r'(?m)^session_id:[ \t]*([^"\s][^\n]*?)[ \t]*$', 1)
    unescaped = F.get_json_object(F.concat(F.lit('{"v":"'), quoted, F.lit('"}')), "$.v")
    return F.when(quoted != "", unescaped).when(bare != "", bare)


def stored_msg_count(note: Column, anywhere: bool = False) -> Column:
    """The high-water mark of a note: its last valid msg_count, or null."""
    found = F.regexp_extract_all(front_matter_text(note, anywhere), F.lit(r"(?m)^msg_count: (-?[0-9]+)$"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("int")


def heading_count(note: Column) -> Column:
    """Lines that begin like a message heading, anywhere in the note or message."""
    return F.regexp_count(note, F.lit(r"(?m)^## [QA][0-9]+"))


def fenced_heading_counts(note: Column) -> Column:
    """struct(q, a): lines that are a message heading, outside fenced code."""
    state = F.struct(F.lit(False).alias("code"), F.lit(0).alias("q"), F.lit(0).alias("a"))

    def step(s: Column, line: Column) -> Column:
        fence = line.startswith("```")
        counts = lambda letter: F.when(~fence & ~s["code"] & line.rlike(rf"\A## {letter}(?U:\d+)\z"), 1).otherwise(0)
        return F.struct((s["code"] != fence).alias("code"), (s["q"] + counts("Q")).alias("q"), (s["a"] + counts("A")).alias("a"))

    return F.aggregate(F.split(note, "\n", -1), state, step, lambda s: F.struct(s["q"].alias("q"), s["a"].alias("a")))


def marks(notes: DataFrame) -> DataFrame:
    """filename, head (the front matter with its two lines), head_bytes, q and a (see fenced_heading_counts) of notes
    (filename, markdown)."""
    head = F.regexp_extract("markdown", r"\A(---\n(?s:.*?\n)??---(?:\n|\z))", 1)
    rows = notes.select("filename", head.alias("head"), fenced_heading_counts(F.col("markdown")).alias("n"))
    return rows.select("filename", "head", F.octet_length("head").cast("long").alias("head_bytes"), F.col("n.q").cast("long").alias("q"), F.col("n.a").cast("long").alias("a"))


def with_msg_count(note: Column, count: Column) -> Column:
    """The note with msg_count in its front matter replaced, or put before the closing line."""
    line = F.concat(F.lit("msg_count: "), count.cast("string"), F.lit("\n"))
    matter = front_matter_text(note)
    rest = F.substring(note, F.length(matter) + 5, F.length(note))
    changed = F.when(matter.rlike(r"(?m)^msg_count: "), F.regexp_replace(matter, F.lit(r"(?m)^msg_count: .*\n"), line)).otherwise(F.concat(matter, line))
    return F.concat(F.lit("---\n"), changed, rest)
