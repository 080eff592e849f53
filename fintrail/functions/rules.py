"""Rule tables compiled to column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F


def first_match(text: Column, rules: Iterable[tuple[str, str]], default: str | None) -> Column:
    """Label of the first pattern found in the text, case-insensitive."""
    out = None
    for pattern, label in rules:
        hit = text.rlike("(?i)" + pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default))


def hits(text: Column, patterns: Iterable[str]) -> Column:
    """How many of the patterns occur in the text, case-insensitive."""
    total = F.lit(0)
    for pattern in patterns:
        total = total + text.rlike("(?i)" + pattern).cast("int")
    return total


def lookup(key: Column, table: Mapping[str, object], default=None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))
