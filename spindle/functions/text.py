"""Text functions on columns: stripping, file names, YAML escapes, titles, ids and dates.

All are built-in expressions, so they stay inside the JVM and can be used in any plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space in a text (Unicode, with the ASCII separators).
_SPACES = r"\s\x0b\x1c-\x1f\x85\p{Z}"
WS = f"[{_SPACES}]"
#: Characters that a file name may not hold, control characters, the longest name.
ILLEGAL, CONTROL, NAME_LENGTH = r'[<>:"/\\|?*]', r"[\x00-\x1f\x7f]", 50
#: Beginnings of messages and of lines that give no title (compared in lower case).
SYSTEM_STARTS = ("<user_instructions", "<instructions", "# agents.md", "<environment_context", "<uploaded_file", "---\ntitle:")
BOILERPLATE_STARTS = ("implement the following plan", "review the current code changes", "user action", "user instructions")
#: Beginnings of user messages that are context, not conversation (case counts).
CONTEXT_STARTS = ("# AGENTS.md", "<INSTRUCTIONS>", "<environment_context>", "<uploaded_file")
TITLE_LEAST, UNTITLED, SHORT_ID, KEY_LENGTH = 5, "untitled", 8, 64
#: A tag with its end and what it holds, any tag; shapes of dates and of UUIDs; what ids keep.
PAIRED_TAG, ANY_TAG = r"(?s)<([a-zA-Z][\w-]*)(?:\s[^>]*)?>.*?</\1>", r"<[^>]+?>"
DATE_SHAPE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
UUID_SHAPE = r"\A[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\z"
NOT_IN_IDS = "[^A-Za-z0-9_-]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once; Spark makes an expression anew at each place of a condition that has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    # Most texts have nothing to strip, which their two ends tell without a search of the whole.
    at_ends = lambda x: F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))).rlike(WS)
    return let(text, lambda x: F.when(at_ends(x), F.regexp_replace(x, rf"\A{WS}+|{WS}+\z", "")).otherwise(x))


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WS}+", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{_SPACES}]")


def starts_with_any(text: Column, starts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | text.startswith(s)
    return out


def _begins_with_any(text: Column, starts: tuple[str, ...]) -> Column:
    """The same in lower case; no more of the text is looked at than the longest start."""
    return let(F.lower(F.left(text, F.lit(max(map(len, starts))))), lambda x: starts_with_any(x, starts))


def _named(text: Column) -> Column:
    """Empty, . and .. are no names. One expression, so that the text before it is made once."""
    return F.regexp_replace(text, r"\A\.{0,2}\z", UNTITLED)


def _strip_dots(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\.+|\.+\z", "")


def sanitize_export(title: Column) -> Column:
    """File name part of an exported conversation: cut to length first, then dots go."""
    clean = F.regexp_replace(F.regexp_replace(title, f"{ILLEGAL}|{CONTROL}", ""), f"{WS}+", "_")
    return _named(_strip_dots(F.substring(clean, 1, NAME_LENGTH)))


def sanitize_session(title: Column) -> Column:
    """File name part of a session: runs of _ are one, dots go, then it is cut to length."""
    clean = F.regexp_replace(F.regexp_replace(title, f"{CONTROL}|{ILLEGAL}", ""), f"{WS}+", "_")
    return _named(F.substring(_strip_dots(F.regexp_replace(clean, "_+", "_")), 1, NAME_LENGTH))


def sanitize_rollout(title: Column) -> Column:
    """As for a session, but only U+0020 becomes _."""
    clean = F.replace(F.regexp_replace(title, f"{CONTROL}|{ILLEGAL}", ""), F.lit(" "), F.lit("_"))
    return _named(F.substring(_strip_dots(F.regexp_replace(clean, "_+", "_")), 1, NAME_LENGTH))


def yaml_escape(text: Column) -> Column:
    """Inside of a double-quoted YAML (JSON) string, ASCII only: UTF-16 units as \\uXXXX."""
    short = F.create_map(*(F.lit(x) for pair in (('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")) for x in pair))

    def one(part: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(part, "UTF-16BE"))), "(.{4})", r"\\u$1")
        return F.when(part.rlike(r'\A[ !#-\[\]-~]+\z'), part).otherwise(F.coalesce(F.try_element_at(short, part), units))

    # Runs of plain characters are one part; every other character is a part of its own.
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r'(?s)[ !#-\[\]-~]+|.'), F.lit(0)), one), "")


def heading_export(title: Column) -> Column:
    return F.replace(F.replace(title, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


def heading(title: Column) -> Column:
    return F.translate(title, "\n\r", "")


def strip_tags(text: Column) -> Column:
    """Without paired tags and what they hold, then without any other tag, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(text, PAIRED_TAG, ""), ANY_TAG, ""))


def title_of(text: Column) -> Column:
    """The first line of a message that can be its title, or null."""

    def first_line(bare: Column) -> Column:
        lines = F.transform(F.split(bare, "\n", -1), strip)
        told = F.filter(lines, lambda x: ~_begins_with_any(x, BOILERPLATE_STARTS) & ~x.isin("", "---", "#"))
        plain = F.filter(F.transform(told, lambda x: F.regexp_replace(x, rf"\A#+{WS}*", "")), lambda x: F.length(x) >= TITLE_LEAST)
        return F.when(~_begins_with_any(bare, SYSTEM_STARTS), F.substring(F.get(plain, F.lit(0)), 1, NAME_LENGTH))

    return let(strip_tags(strip(text)), first_line)


def short_id(session_id: Column) -> Column:
    """The first eight harmless characters of an id, or of its SHA-256 if it has none."""
    clean = F.substring(F.regexp_replace(session_id, NOT_IN_IDS, ""), 1, SHORT_ID)
    return F.coalesce(F.nullif(clean, F.lit("")), F.substring(F.sha2(session_id, 256), 1, SHORT_ID))


def state_key(session_id: Column) -> Column:
    return F.substring(F.regexp_replace(session_id, NOT_IN_IDS, ""), 1, KEY_LENGTH)


def date_from_epoch(seconds: Column, utc: bool = False) -> Column:
    """Date in the session's time zone, or UTC; null, missing and 0 are unknown."""
    at = F.coalesce(seconds, F.lit(0.0))
    day = F.date_from_unix_date(F.floor(at / 86400).cast("int")) if utc else F.timestamp_seconds(at)
    return F.when(at == 0, "unknown").otherwise(F.date_format(day, "yyyy-MM-dd"))


def date_prefix(timestamp: Column) -> Column:
    """What stands before T, without any conversion of zones."""
    return F.split_part(timestamp, F.lit("T"), F.lit(1))


def has_date_shape(date: Column) -> Column:
    return F.coalesce(date.rlike(DATE_SHAPE), F.lit(False))


def is_date(date: Column) -> Column:
    return has_date_shape(date) & date.try_cast("date").isNotNull()


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID_SHAPE), F.lit(False))


def counter_value(text: Column) -> Column:
    """A stored counter; anything but digits counts as 0."""
    return F.when(text.rlike(r"\A[0-9]+\z"), F.coalesce(text.try_cast("bigint"), F.lit(0))).otherwise(F.lit(0).cast("bigint"))
