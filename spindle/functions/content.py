"""Message content as VARIANT: strings, lists of strings and objects, or anything else.

Five ways to flatten it, one for each place that reads it. ``kind`` of a missing value is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_text(v: Column) -> Column:
    return kind(v) == "STRING"


def _is_list(v: Column) -> Column:
    return F.startswith(kind(v), F.lit("ARRAY"))


def _string(v: Column) -> Column:
    return v.cast("string")


def _items(v: Column) -> Column:
    return F.when(_is_list(v), v).cast("array<variant>")


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def _typed(v: Column, *types: str) -> Column:
    return field(v, "type").isin(*types)


def flatten_export(parts: Column) -> Column:
    """An array of VARIANT: the strings, one per line; null if there is none."""
    found = F.transform(F.filter(parts, _is_text), _string)
    return F.when(F.size(found) > 0, F.array_join(found, "\n"))


def flatten_event(content: Column) -> Column:
    """Strings and text objects, one per line; other content is empty."""
    kept = F.filter(_items(content), lambda x: F.coalesce(_is_text(x) | (_typed(x, "text") & field(x, "text").isNotNull()), F.lit(False)))
    lines = F.transform(kept, lambda x: F.when(_is_text(x), _string(x)).otherwise(field(x, "text")))
    return F.when(_is_text(content), _string(content)).when(_is_list(content), F.array_join(lines, "\n")).otherwise("")


def flatten_body(content: Column) -> Column:
    """As flatten_event, but an item that is neither leaves an empty line, JSON null is None, missing
    content is empty and any other value is its JSON text."""
    lines = F.transform(_items(content), lambda x: F.when(_is_text(x), _string(x)).when(_typed(x, "text"), F.coalesce(field(x, "text"), F.lit(""))).otherwise(""))
    return (
        F.when(content.isNull(), "")
        .when(F.is_variant_null(content), "None")
        .when(_is_text(content), _string(content))
        .when(_is_list(content), F.array_join(lines, "\n"))
        .otherwise(F.to_json(content))
    )


def flatten_rollout(content: Column) -> Column:
    """The texts of input_text and output_text objects, one per line; a missing text is empty."""
    kept = F.filter(_items(content), lambda x: F.coalesce(_typed(x, "input_text", "output_text"), F.lit(False)))
    return F.when(_is_list(content), F.array_join(F.transform(kept, lambda x: F.coalesce(field(x, "text"), F.lit(""))), "\n")).otherwise("")


def flatten_title(content: Column) -> Column:
    """Strings and any object with a text, one per line; null for content without either form."""
    kept = F.filter(_items(content), lambda x: F.coalesce(_is_text(x), F.lit(False)) | field(x, "text").isNotNull())
    lines = F.transform(kept, lambda x: F.when(_is_text(x), _string(x)).otherwise(field(x, "text")))
    return F.when(_is_text(content), _string(content)).when(_is_list(content), F.array_join(lines, "\n"))
