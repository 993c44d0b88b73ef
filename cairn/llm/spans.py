"""Spans of findings in texts, and the digest columns that queries derive from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of one finding; start and end are code points, end exclusive.
SPAN = "kind string, start int, end int, score double, base boolean"


def span_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined, in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def ordered(found: Iterable[tuple], kinds: list[str]) -> list[tuple]:
    """By start, then kind as listed, then end."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(found, key=lambda s: (s[1], rank[s[0]], s[2]))


def bare_string(values: list[str | None]) -> list[str]:
    return [v or "" for v in values]
