"""Column expressions for parsing and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, separator: str = " ") -> Column:
    """Split on a separator and drop trailing empty pieces; a text of separators alone, or null, has none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"\\Q{separator}\\E", -1)
    last = F.array_max(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    return F.slice(parts, 1, last)


def event_time(millis: Column) -> Column:
    """Epoch milliseconds as a timestamp."""
    return F.timestamp_millis(millis)


def key_seconds(line: Column) -> tuple[Column, Column]:
    """(key, milliseconds) of a line "key seconds"."""
    parts = F.split(line, " ")
    return parts[0], parts[1].cast("bigint") * 1000


def int_div(a: str, b: str) -> Column:
    """Division of two columns, by name, that truncates toward zero."""
    return F.expr(f"`{a}` div `{b}`")


def csv_fields(line: Column, names: list[str]) -> list[Column]:
    """The comma-separated fields of a line, by name; missing ones are null."""
    parts = F.split(line, ",")
    return [F.get(parts, i).alias(n) for i, n in enumerate(names)]
