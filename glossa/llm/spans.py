"""Matches of patterns with their places, as column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,kind:int,end:int>>"


def found(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans (start, kind, end; code points, end exclusive) of the leftmost non-overlapping matches that pass `keep`.

    split() gives the lengths between the matches, so a running sum over both gives the places.
    """
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + piece["gap"]
        end = start + F.coalesce(F.length(piece["m"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        good = piece["m"].isNotNull() if keep is None else piece["m"].isNotNull() & keep(piece["m"])
        return F.struct(end.alias("at"), F.when(good, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    empty = F.array().cast(SPANS)
    folded = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda state: state["spans"])
    return F.when(text.rlike(pattern), folded).otherwise(empty)


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of spans in order, joined by commas."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def clear_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])))
